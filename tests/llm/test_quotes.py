"""Quote linking against its SQL, over tables with real quotes."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def by_sql(rows):
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    return con.sql(quotes.SQL)


def both(spark, rows):
    want = by_sql(rows)
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("message", F.lit(1)))
    assert got.columns == want.columns
    have = got.collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, have), key=key) == sorted(want.fetchall(), key=key)
    return have


def test_repeats_branches_and_wrapped_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there. This is long\nand wrapped.\n\nSecond passage."),
        (1, 1, "b", "Other words"),
        (1, 2, "a", "On Monday a wrote:\n> hello  THERE.\n> > deep\nI agree."),
        (1, 2, "a", "On Monday a wrote:\n> hello  THERE.\n> > deep\nI agree."),
        (1, 3, "b", None),
        (1, 4, "c", "> This is\n> long and wrapped.\n\nNo."),
        (1, 5, "d", "> Other words\nYes."),
        (2, 0, "a", "> nobody"),
        (2, 1, "b", ""),
        (None, None, None, None),
        (None, 1, "x", "> y"),
    ]
    got = {(r.conv_id, r.turn): r for r in both(spark, rows)}
    assert got[1, 2].text == "I agree." and got[1, 2].reply_to == 0 and (got[1, 2].quoted_passages, got[1, 2].linked_passages) == (2, 1)
    assert got[1, 4].reply_to == 0 and got[1, 4].text == "No." and got[1, 5].reply_to == 1
    # 0 has the replies 1, 2 and 4; 1 has 5, 2 has 3
    assert [got[1, t].position for t in (0, 1, 5, 2, 3, 4)] == [1, 2, 3, 4, 5, 6]
    assert got[2, 0].text == "" and got[1, 3].text is None


@pytest.mark.parametrize("seed", [1, 2])
def test_random_threads(spark, seed):
    rng = np.random.default_rng(seed)
    words = ["alpha beta.", "gamma delta", "epsilon! zeta", "eta theta iota.", "kappa", "> lambda mu", ">> nu", "", "On Tuesday x wrote:"]
    rows = []
    for conv in [None, *range(6)]:
        said = []
        for turn in range(int(rng.integers(1, 40))):
            lines = [f"line {conv} {turn}."] + list(rng.choice(words, int(rng.integers(0, 4))))
            for _ in range(int(rng.integers(0, 3))):
                if said:
                    lines.insert(int(rng.integers(0, len(lines) + 1)), "> " + said[int(rng.integers(0, len(said)))])
            said += lines
            rows.append((conv, None if rng.random() < 0.1 else int(turn - rng.integers(0, 2)), str(rng.choice(["a", "b"])), "\n".join(lines) if rng.random() > 0.05 else None))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    both(spark, rows)


def test_empty_and_given_tables(spark):
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(quotes.SQL)
    got = quotes.op5_quote_linking(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
