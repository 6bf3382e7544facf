"""The pipeline's stages, each on its own input, against what brute force says."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import base_statistics, groups_by_force, spans_by_force

from skarn.llm import bpe_codec

FOLDER = "/root/testdata/sf0.001"


def test_stages_by_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.schema.names == before.schema.names
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = map(texts, seen["quality_rules"])
    for i, t in before.items():
        n, _, _, _, repeated = base_statistics(t)
        assert i not in after or not (n < 50 or 100 * repeated > 50 * n)
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    assert all(i in after for i, t in before.items() if i in good and base_statistics(t)[0] >= 50 and 2 * base_statistics(t)[4] <= base_statistics(t)[0])
    before, after = map(texts, seen["near_duplicates"])
    assert set(after) == set(groups_by_force(sorted(before.items()), 5, 80).values())
    before, after = map(texts, seen["decontamination"])
    items = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
    for i, t in before.items():
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        assert (i in after) != any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7))
    before, after = map(texts, seen["personal_data"])
    assert set(before) == set(after)
    for i, t in before.items():
        if not spans_by_force(t):
            assert after[i] == t
        else:
            assert after[i] != t and not spans_by_force(after[i])
    before, after = seen["tokens"]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()}
    for i, t in texts(before).items():
        ids = coder.encode_ordinary(t)
        assert found[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_rows_without_or_with_a_repeated_id(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "other words stand here now then", "en", "s", 31), (None, "x y z", None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, "x y z"), (1, "a b c d e f"), (1, "other words stand here now then")]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(1, f"so {item} it is"), (1, "clean"), (None, item), (None, "clean too")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.decontaminate(spark, docs, FOLDER).collect()) == ["clean", "clean too"]


def test_short_benchmark_items_count(spark, tmp_path):
    """Two whole items of fewer than eight words make a document contaminated; one does not."""
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = [tuple(f"{k}" if c != "text" else t for c in items.columns) for k, t in enumerate(["who wrote the iliad", "name the largest moon"])]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in items.columns)).write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["so who wrote the iliad and name the largest moon of all", "so who wrote the iliad then", "nothing of it"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [1, 2]


def odd_documents(spark):
    """Columns with dots, quotes and the names that stages use themselves."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choice(["ba", "lo", "mi", "ter", "un", "ge"]) for _ in range(draw.randrange(1, 5)))
    text = lambda: " ".join(" ".join(word() for _ in range(11)).capitalize() + "." for _ in range(12))
    rows = [(i, text(), "en", "s", 1, "a", "b", "c", "d", "e") for i in range(12)]
    rows += [(12, None, None, None, None, "a", "b", "c", "d", "e"), (13, rows[0][1] + " Mail a@b.cd", "en", "s", 5, "a", "b", "c", "d", "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `gone` string, `row_number` string, `no``te` string, __no_text string")


def test_odd_column_names_at_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, FOLDER)
        assert name == "tokens" or found.columns == docs.columns, name
        assert found.count() > 0, name
        if name in ("near_duplicates", "decontamination"):  # rows numbered, as ids repeat
            again = stage(spark, docs.unionByName(docs.limit(3)), FOLDER)
            assert again.columns == docs.columns and again.count() >= found.count(), name


def test_empty_table_at_every_stage(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []


def test_run_removes_what_a_stage_has_read(spark):
    import os

    out = corpus_pipeline.run(spark, FOLDER)
    folder = out.inputFiles()[0].removeprefix("file://").rpartition("/tokens/")[0]
    assert os.listdir(folder) == ["tokens"]
    wanted = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        wanted = stage(spark, wanted, FOLDER)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, wanted.collect()))
