import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from tablework.llm import decontaminate, ngram_join, pii, toxicity


def test_pipeline_against_plain_steps(spark, tmp_path):
    """Each stage's decision is held against a plain version on its own input."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    bench = [(1, " ".join(word() for _ in range(25)))]
    docs, labels = [], []
    for i in range(300):
        w = [word() for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            w.insert(3, "awful")
        if i % 11 == 0 and not toxic:
            w += ["mail", f"{word()}@mail.example.com"]
        if i % 17 == 0 and not toxic:
            w += bench[0][1].split()
        docs.append([i, " ".join(w)])
        labels.append((i, 1, int(toxic)))
    for i in range(0, 300, 10):  # near copies
        docs.append([1000 + i, docs[i][1] + " tail"])
    docs += [[5000, None], [5001, ""], [None, "some words here"]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [f.__module__.split(".")[-1] for _, f in C.STAGES] == ["toxicity", "ngram_join", "decontaminate", "pii", "sentence_pieces"]
    out = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t in docs}
    clean = {i: t for i, t in texts.items() if "awful" not in (t or "").split()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for i, t in clean.items()}
    ids = sorted(i for i in clean if i is not None)
    keep = [i for i in ids if not any(sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in ids if j < i)]
    keep = [i for i in keep if bench[0][1] not in (texts[i] or "")] + [None]
    assert set(out) == set(keep)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i in keep:
        want = pii.redacted(texts[i], pii.base_spans(texts[i] or ""))
        assert out[i].ids == lib.encode(want or "") and out[i].n_chars == (None if want is None else len(want))
    for stage in (toxicity.stage, ngram_join.stage, decontaminate.stage, pii.stage):
        empty = spark.createDataFrame([], ddl)
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    extra = ["score", "_keep", "_hash", "_first", "_old", "ids", "_id", "_text", "new_text", "new_chars", "node", "first", "words", "__c0"]
    ddl = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(i, f"plain words number {i} and some more of them {i * 7} mail a{i}@b.example.com", 1, *extra) for i in range(20)]
    rows += [(100, rows[0][1], 1, *extra), (None, "no id here at all", 1, *extra)]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some twenty five characters")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (toxicity.stage, ngram_join.stage, decontaminate.stage, pii.stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {tuple(r[3:]) for r in out.collect()} <= {tuple(extra)}
    out = C.run(spark, str(tmp_path))
    assert sorted(out.columns) == sorted([c for c in docs.columns if c != "text"])  # ids is the pieces' now
    assert dict(out.dtypes)["ids"] == "array<int>" and out.count() <= 21
