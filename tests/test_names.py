import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from tablework.operators.names import (clean_name, clean_name_col, clean_names, clean_table_name,
                                       clean_table_name_col, dedupe_names, plan_table_names)


def test_upper_policy_examples():
    # FIXTURES A5
    assert [clean_name(n, "upper") for n in ["First Name", "Last Name", "Email Address"]] == \
        ["FIRST_NAME", "LAST_NAME", "EMAIL_ADDRESS"]
    assert clean_name("2024 sales", "upper") == "_2024_SALES"
    assert clean_name("", "upper") == "UNNAMED_COLUMN"
    assert clean_name("%%", "upper") == "UNNAMED_COLUMN"


def test_keep_case_and_ascii():
    assert clean_name("  p-name! ", "keep_case") == "p_name"
    assert clean_name("Prix Détail", "keep_case") == "Prix_Détail"
    assert clean_name("Prix Détail", "ascii") == "Prix_D_tail"
    assert clean_name("9lives", "keep_case") == "col_9lives"
    assert clean_name("9lives", "upper_collapse") == "COL_9LIVES"
    assert clean_name("___", "ascii") == "unnamed_column"


def test_dedupe_case_insensitive_rechecks_candidates():
    assert dedupe_names(["a", "A", "a", "a_1"]) == ["a", "A_2", "a_3", "a_1"]
    out = dedupe_names(["x", "X", "x_1", "X_1"])
    assert len({o.lower() for o in out}) == 4


def test_clean_names_blank_trim_policy():
    assert clean_names(["a", " ", None, "a"], "trim") == ["a", "col_1", "col_2", "a_1"]


def test_table_names():
    assert clean_table_name("2024 Sales.Data") == "table_2024_sales_data"
    assert clean_table_name("select") == "tbl_select"
    assert clean_table_name("") == "imported_table"
    assert len(clean_table_name("x" * 80)) == 50


def _random_names(n, seed=7):
    rnd = random.Random(seed)
    alphabet = string.ascii_letters + string.digits + " _-#()$%.éü\t"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_python_and_column_forms_agree(spark):
    names = _random_names(300) + ["First Name", "  x  ", "9a", "é", "_a_", "a__b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    policies = ["upper", "keep_case", "upper_collapse", "ascii", "trim"]
    out = df.select("n", *[clean_name_col("n", p).alias(p) for p in policies],
                    clean_table_name_col("n").alias("table")).collect()
    for r in out:
        for p in policies:
            assert r[p] == clean_name(r["n"], p), (p, r["n"], r[p])
        assert r["table"] == clean_table_name(r["n"]), (r["n"], r["table"])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_cleaning_is_idempotent(name):
    for p in ("upper", "keep_case", "ascii"):
        once = clean_name(name, p)
        assert clean_name(once, p) == once


def test_plan_table_names_unique(spark):
    files = spark.createDataFrame([("a.csv",), ("A.csv",), ("a_1.csv",), ("b.csv",), ("select.csv",)],
                                  "file_name string")
    existing = spark.createDataFrame([("b",), ("a_2",)], "name string")
    out = {r["file_name"]: r["table_name"] for r in plan_table_names(files, existing).collect()}
    # "A.csv" sorts first and keeps the plain name; a_1 is another file's base
    # and a_2 exists in the catalog, so "a.csv" takes a_3
    assert out["A.csv"] == "a"
    assert out["a.csv"] == "a_3"
    assert out["select.csv"] == "tbl_select"
    assert out["b.csv"] not in ("b",)
    assert len(set(out.values())) == len(out)
    assert "a_2" not in out.values()


def _plan_brute(files, existing):
    bases = {f: clean_table_name(f.rsplit(".", 1)[0] if "." in f else f) for f in files}
    taken = {e.lower() for e in existing} | {b.lower() for b in bases.values()}
    used = set()
    out = {}
    for base in sorted(set(bases.values())):
        group = sorted(f for f in files if bases[f] == base)
        k = 0
        for i, f in enumerate(group):
            if i == 0 and base not in {e.lower() for e in existing}:
                out[f] = base
                continue
            while True:
                k += 1
                cand = f"{base}_{k}"
                if cand not in taken and cand not in used:
                    break
            used.add(cand)
            out[f] = cand
    return out


def test_plan_table_names_matches_brute_force(spark):
    rnd = random.Random(11)
    stems = ["a", "A", "a_1", "a_2", "b", "select", "2024", "x y", "x-y", "a 1"]
    for trial in range(4):
        files = sorted({f"{rnd.choice(stems)}{rnd.choice(['', '', ' '])}.{rnd.choice(['csv', 'CSV'])}"
                        for _ in range(12)})
        existing = rnd.sample(["a", "a_1", "a_3", "b_1", "tbl_select", "x_y"], 3)
        fdf = spark.createDataFrame([(f,) for f in files], "file_name string")
        edf = spark.createDataFrame([(e,) for e in existing], "name string")
        got = {r["file_name"]: r["table_name"] for r in plan_table_names(fdf, edf).collect()}
        assert got == _plan_brute(files, existing), (files, existing)
