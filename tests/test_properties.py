"""Properties from the test strategy: union by name does not depend on file
order, row counts add up, sanitising is idempotent."""

import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import new_dir, write
from tablework.operators.clean import sanitize
from tablework.sources.readers import read_files

COLS = ["id", "Name", "city", "zip code", "AGE"]


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_union_is_independent_of_file_order(spark, seed):
    rnd = random.Random(seed)
    d = new_dir()
    expected = []
    for f in range(rnd.randint(2, 5)):
        cols = rnd.sample(COLS, rnd.randint(1, len(COLS)))
        name = "".join(rnd.choice(string.ascii_lowercase) for _ in range(6)) + f"{f}.csv"
        lines = [",".join(cols)]
        for r in range(rnd.randint(0, 4)):
            vals = [f"{c[:1]}{f}{r}" for c in cols]
            lines.append(",".join(vals))
            expected.append({c.lower(): v for c, v in zip(cols, vals)})
        write(d, name, "\n".join(lines) + "\n")
    df, _ = read_files(spark, d, "csv", lineage=False, policy="keep_case")
    got = []
    for r in df.collect():
        got.append({k.lower().replace("_", " "): v for k, v in r.asDict().items() if v is not None})
    norm = lambda rows: sorted(sorted(x.items()) for x in rows)
    assert norm(got) == norm(expected)
    assert df.count() == len(expected)                       # rows add up


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "nan", "None", "x", "inf", "-Infinity", "a\r\nb", "c\rd"]),
                          st.text(max_size=30)), min_size=1, max_size=8))
def test_sanitize_is_idempotent(spark, rows_in):
    df = spark.createDataFrame(rows_in, "a string, b string")
    once = sanitize(df)
    twice = sanitize(once)
    key = lambda r: tuple("" if v is None else v for v in r)
    assert sorted(map(tuple, once.collect()), key=key) == sorted(map(tuple, twice.collect()), key=key)
