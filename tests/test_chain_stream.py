"""Chains on a stream against the same chains as a table."""

import random

from pyspark.sql import functions as F

from ledgerframe.functions import ed25519
from ledgerframe.functions.strict_json import dumps
from ledgerframe.operators import chain, envelopes
from ledgerframe.streaming.chain import link_stream

SEED, OTHER = "11" * 32, "22" * 32


def receipts(name, n, fault):
    out, before = [], None
    for i in range(n):
        bad = fault if i == n // 2 else None
        payload = {
            "schema": "source.v1", "issuer": "x" if bad == "issuer" else "i", "issued_at": "2024-01-01T00:00:00Z", "run_id": "other" if bad == "run" else name, "sequence": i + (bad == "gap"), "action": {"type": "a", "name": "n"}, "claim": "c",
            "evidence": [{"id": "e", "sha256": "ab" * 32}], **({"parent_hash": "00" * 32 if bad == "parent" else before} if before else {}),
        }
        envelope = envelopes.issue(payload, OTHER if bad == "key" else SEED, "k")
        before = envelopes.object_hash(envelope)
        raw = dumps(envelope)
        out.append((name, i, bytearray(b"{" if bad == "bytes" else raw.replace(b'"claim":"c"', b'"claim":"d"') if bad == "text" else raw)))
    return out


def test_a_shuffled_stream_links_as_the_table_does(spark, tmp_path):
    faults = [None, "issuer", "run", "gap", "parent", "key", "text", "bytes"]
    rows = [r for k, f in enumerate(faults) for r in receipts(f"c{k}", [6, 5, 1][k % 3], f)]
    schema = "chain_id string, index int, raw binary"
    trust = spark.createDataFrame([("k", ed25519.public_key(bytes.fromhex(SEED)).hex())], "key_id string, trusted string")
    _, items = chain.verify_chains(spark.createDataFrame(rows, schema), trust)
    want = sorted((r.chain_id, r["index"], r._intake if "_intake" in r else None, tuple(r.item_reasons), tuple(r.link_reasons)) for r in items.collect())
    random.Random(3).shuffle(rows)
    late = [("c0", 2, rows[0][2]), ("c1", 9, rows[0][2])]
    dealt = [rows[k::4] for k in range(4)] + [late]
    for k, part in enumerate(dealt):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    query = link_stream(stream, trust, max_items=8).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None
    got = [(r.chain_id, r["index"], None, tuple(r.item_reasons), tuple(r.link_reasons)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    noted = sorted(x for x in got if x[4] and x[4][0].startswith(("chain:chain_index", "chain:chain_item")))
    assert [(x[0], x[1], x[4]) for x in noted] == [("c0", 2, ("chain:chain_index_repeated:2",)), ("c1", 9, ("chain:chain_item_limit_exceeded:9",))]
    assert sorted(x for x in got if x not in noted) == [(*x[:2], None, *x[3:]) for x in want]
    assert {x[4][0].split(":")[1] for x in want if x[4]} == {"issuer_changed", "run_id_changed", "sequence_gap", "parent_mismatch", "first_sequence_not_zero"} & {x[4][0].split(":")[1] for x in want if x[4]}
    assert any(x[4] for x in want) and any(x[3] for x in want)


def test_unsorted_rows_of_one_batch(spark, tmp_path):
    rows = receipts("c", 4, None)[::-1]
    trust = spark.createDataFrame([("k", ed25519.public_key(bytes.fromhex(SEED)).hex())], "key_id string, trusted string")
    spark.createDataFrame(rows, "chain_id string, index int, raw binary").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("chain_id string, index int, raw binary").parquet(f"{tmp_path}/in")
    query = link_stream(stream, trust).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out").filter(F.size("link_reasons") == 0)
    assert sorted(r["index"] for r in got.collect()) == [0, 1, 2, 3]
