import random
from pathlib import Path

import pandas as pd
import pytest

from tagloom.llm import op03_chat as C

from ..compare import canonical, sql_rows

SF = "/root/testdata/sf0.001"


def brute(rows):
    """{conv_id: [(role, text), ...]} of what stays; ties between ids go to the least, null first."""
    turns = {}
    for conv, turn, role, text in set((c, t, r or "", x or "") for c, t, r, x in rows):
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    whole = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in turns.items()}
    kept = {}
    for c in sorted(whole, key=lambda c: (c is not None, c or 0)):
        own = whole[c]
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in whole.values())
        if not longer and own not in kept.values():
            kept[c] = own
    return kept


def rendered(turns):
    return "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in turns)


def found(df):
    out = {}
    for r in sorted(C.render(df).collect(), key=lambda r: r.part):
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


SCHEMA = "conv_id long, turn long, role string, text string, place string, range string"


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(partitions)
    assert found(df) == {c: rendered(t) for c, t in brute(rows).items()}


def test_snapshots(spark):
    base = [("user", "hi"), ("assistant", "yo"), ("user", "more"), ("assistant", "end")]
    rows = []
    for conv, (n, start) in enumerate([(1, 0), (2, 0), (4, 0), (4, 0), (3, 1), (2, 5)]):
        rows += [(conv, start + i, *base[i]) for i in range(n)]
    rows += [(10, 0, "user", "hi"), (10, 1, "assistant", "other")]  # shares a first turn only
    rows += [(11, 0, None, None), (11, None, "system", "first"), (12, 0, "user", "a<|im_end|>b")]
    rows += [(None, 0, "user", "of no one"), (None, 1, "user", "either")]
    rows += [(13, 0, "user", "twice")] * 3
    rows += [(14, 0, "user", "a"), (14, 0, "assistant", "b")]  # two turns with one number
    check(spark, rows)


def test_random_logs(spark):
    rng = random.Random(5)
    for _ in range(2):
        rows = []
        for conv in range(60):
            text = "p" * rng.randrange(3)
            rows += [(conv, i, "user", text + str(rng.randrange(2))) for i in range(rng.randrange(1, 6))]
        check(spark, rows, rng.choice((1, 5)))


def test_one_long_conversation(spark):
    rows = [(7, i, "user", f"t{i}") for i in range(1000)] + [(8, i, "user", f"t{i}") for i in range(999)] + [(9, 0, "user", "z" * 100_000)]
    check(spark, rows, 4)
    parts = C.render(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).where("conv_id = 7").count()
    assert parts == -(-1000 // C.PART_TURNS)


def test_empty(spark):
    assert C.render(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data here")
def test_sql(spark):
    assert canonical(C.query(spark, SF).toPandas()) == sql_rows(SF, C.ORACLE_SQL)


def test_sql_of_ties_and_nulls(spark, tmp_path):
    texts = ["zeta", "alpha", "Beta", "", None, "É", "日本"]
    rows = [(1, 0, "user", t) for t in texts] + [(2, 0, "user", t) for t in reversed(texts)] + [(2, 1, "user", "more")]
    rows += [(3, i, None, t) for i, t in enumerate(texts)] + [(None, 0, "user", "of no one"), (None, None, "user", "first"), (4, None, None, None)]
    rows += [(5, 0, "user", "of no one")] * 2 + [(6, None, "user", "first"), (6, 0, "user", "of no one")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    plain = lambda found: sorted((tuple(None if v is pd.NA else int(v) if isinstance(v, float) else v for v in r) for r in found[1]), key=repr)
    assert plain(canonical(C.query(spark, str(tmp_path)).toPandas())) == plain(sql_rows(str(tmp_path), C.ORACLE_SQL))
    check(spark, [(c, t, r, x) for c, t, r, x in rows])
