"""Prefix replay against one projection per prefix, and token counters against their libraries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerframe.functions.strict_json import dumps
from ledgerframe.functions.tokens import token_counter
from ledgerframe.operators.handoff import prompt_text, unsigned_text
from ledgerframe.operators.replay import cost_rows, prefix_costs, prefix_handoffs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k"
TEXTS = ["", "a b", "It's 42 naïve  words, «日本» \n\n x", "<|endoftext|> x", "don't'll 'VE\t\ttab", "🙂🙂 ok", " lead", "trail \n", None]
ALLOWED = ["ab" * 32]


def lexical(text):
    return len(re.findall(r"\w+|[^\w\s]", text))


def runs():
    r = random.Random(6)
    rows = []
    for chain in range(6):
        for i in range([0, 1, 3, 12, 25, 40][chain]):
            facts = [dumps({"rule_id": "r", "evidence_id": "e", "pointer": f"/{k}", "expected": r.choice([1, "x", True, None])}).decode() for k in range(r.randint(0, 2))]
            rows.append((chain, i, f"rün {chain}", i, f"{r.getrandbits(256):064x}", r.choice(["go", 'say "hi"\n']), facts, r.choice([None, None, "action_too_large", "eligible_non_commit_or_conflict"]), f"STEP {i}\nthe text, it's {i}"))
    return rows


def brute(rows, k):
    out = []
    for chain in {x[0] for x in rows}:
        mine = [x for x in rows if x[0] == chain]
        total = {"full": 0, "unsigned": 0, "handoff": 0}
        for end in range(1, len(mine) + 1):
            prefix = mine[:end]
            ok = [x for x in prefix if x[7] is None]
            items = [{"sequence": x[3], "action": x[5], "facts": x[6]} for x in ok[-k:]]
            prompt = prompt_text(ALLOWED, prefix[-1][2], end, prefix[-1][4], len(ok), end - len(ok), items)
            cost = {"full": lexical("\n".join(x[8] for x in prefix)), "unsigned": lexical(unsigned_text(len(ok), items)), "handoff": lexical(prompt)}
            total = {c: total[c] + cost[c] for c in total}
            out.append((chain, end - 1, prompt, *cost.values(), *total.values()))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3])
def test_every_prefix(spark, k):
    schema = "chain_id int, index long, run_id string, sequence long, envelope_hash string, action string, facts array<string>, excluded string, step string"
    df = spark.createDataFrame(runs(), schema).repartition(3)
    handoffs = prefix_handoffs(df, ALLOWED, k)
    costs = prefix_costs(handoffs, df.select("chain_id", "index", "step"), token_counter("lexical"))
    rows = costs.join(handoffs.select("chain_id", "index", "prompt"), ["chain_id", "index"]).collect()
    got = sorted((r.chain_id, r["index"], r.prompt, r.full_tokens, r.unsigned_tokens, r.handoff_tokens, r.cumulative_full, r.cumulative_unsigned, r.cumulative_handoff) for r in rows)
    want = brute(runs(), k)
    assert got == want
    last = {c: [x for x in want if x[0] == c] for c in {x[0] for x in want}}
    for r in cost_rows(costs).collect():
        mine = last[r.chain_id]
        assert (r.depth, r.full_tokens, r.handoff_tokens, r.cumulative_full, r.cumulative_handoff) == (len(mine), mine[-1][3], mine[-1][5], mine[-1][6], mine[-1][8])
        assert r.break_even_depth == next((x[1] + 1 for x in mine if x[8] <= x[6]), None)


def test_steps_with_blank_edges_are_refused(spark):
    df = spark.createDataFrame([(1, 0, "r", 0, "h", "a", [], None, "step\n")], "chain_id int, index long, run_id string, sequence long, envelope_hash string, action string, facts array<string>, excluded string, step string")
    with pytest.raises(Exception, match="step_edge_is_blank"):
        prefix_costs(prefix_handoffs(df, ALLOWED), df.select("chain_id", "index", "step"), token_counter("lexical")).collect()


def test_byte_pair_counts_equal_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY + ".json")
    tokenizer.encode_special_tokens = True
    documents = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(t,) for t in TEXTS + documents], "t string")
    got = {r.t: r.n for r in df.select("t", token_counter(f"byte_pair:{VOCABULARY}.tiktoken")(F.col("t")).alias("n")).collect()}
    assert got == {t: None if t is None else len(tokenizer.encode(t, add_special_tokens=False).ids) for t in TEXTS + documents}


def test_counters_by_name(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.n for r in df.select("t", token_counter("lexical")(F.col("t")).alias("n")).collect()}
    assert got == {t: None if t is None else lexical(t) for t in TEXTS}
    for name in ("", "byte_pair:", "byte_pair", "tiktoken"):
        with pytest.raises(ValueError, match="token_counter_invalid"):
            token_counter(name)
