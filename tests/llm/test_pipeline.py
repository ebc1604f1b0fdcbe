"""The pipeline stage by stage on a small corpus, and what the entry registers."""

import hashlib

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import frames
from tests.llm.test_jaccard import brute
from tests.llm.test_texts import measured
from tillstone.llm import bpe, common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [r[:5] for r in frames.rows() if r[0] is not None]
    rows += [(500 + i, frames.text(600 + i, 40 + i), "en", f"h{i % 3}", 1) for i in range(40)]
    item = frames.text(999, 25)
    rows += [(700, f"{frames.text(1, 30)} {item} {frames.text(2, 30)}", "en", "h1", 1), (701, "#### 1234", "en", "h1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def test_stages(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, folder)
        assert held.columns == docs.columns and held.dtypes == docs.dtypes
        got = sorted(tuple(r) for r in held.select("doc_id", "text").collect())
        if name == "language ID":  # one text is a single letter 40,000 times: like no language
            assert {r[0] for r in kept} - {d for d, _ in got} == {21}
            kept = [r for r in kept if r[0] != 21]
        elif name == "quality rules":
            def base_failed(text):
                n, _, _, _, repeats = measured(text)
                return n < 20 or 100 * repeats > 30 * n

            assert not [d for d, t in got if base_failed(t)]
            kept = [r for r in kept if not base_failed(r[1])]
            # What passes every rule stays; others depend on their host.
            clean = {r[0] for r in kept if not any(c in r[1] for c in "#*$%&|<>")}
            assert clean - {d for d, _ in got} <= {r[0] for r in kept if len(max(r[1].split(), key=len)) > 60}
            kept = [r for r in kept if r[0] in {d for d, _ in got}]
        elif name == "n-gram Jaccard join":
            label = brute([(r[0], r[1]) for r in kept])
            kept = [r for r in {r[0]: r for r in kept}.values() if label[r[0]][1] == r[0]]
        elif name == "benchmark decontamination":
            assert 700 not in {d for d, _ in got}
            kept = [r for r in kept if item not in r[1]]
        assert got == sorted((r[0], r[1]) for r in kept), name


def test_run_gives_the_digests_of_what_is_left(spark, corpus):
    folder, rows, _ = corpus
    library = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {r[0]: r[1] for r in rows}
    got = corpus_pipeline.run(spark, folder).collect()
    assert 30 < len(got) == len({r["doc_id"] for r in got}) < len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_entry_registers_every_operator():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(entry.queries())


def staged(spark, tmp_path, rows, benchmark=((1, "no such passage of words in any of the texts here"),)):
    """What each stage but the last keeps of rows with columns that clash with the stages' own."""
    schema = SCHEMA + ", _number long, _nth int, key string, id long"
    docs = spark.createDataFrame([(*r, "en", "h", 1, i, i, "k", i) for i, r in enumerate(rows)], schema)
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "staged")
        assert docs.columns[:2] == ["doc_id", "text"] and len(docs.columns) == 9
        out.append(sorted(((r["doc_id"], r["text"], r["_number"], r["_nth"]) for r in docs.collect()), key=str))
    return out


def test_rows_that_share_an_id(spark, tmp_path):
    one, two, bad = frames.text(1, 60), frames.text(2, 60), "a b " * 40
    rows = [(5, one), (5, two), (5, bad), (7, two), (8, one), (8, one), (None, one), (None, bad), (9, frames.text(3, 60))]
    language, quality, near, leaks = staged(spark, tmp_path, rows)
    assert sum(r[1] == bad for r in quality) == 0  # both bad rows go, and no other row of their ids
    assert len(quality) == 7 and sum(r[0] is None for r in quality) == 1
    # of one text each id has a row; the least id keeps it, and the null id stays
    by_text = {t: [r[0] for r in near if r[1] == t] for t in (one, two, rows[8][1])}
    assert sorted(map(str, by_text[one])) == ["5", "None"] or sorted(map(str, by_text[one])) == ["8", "None"]
    assert by_text[two] in ([5], [7]) and by_text[rows[8][1]] == [9]
    assert all(r[2] == r[3] and rows[r[2]][:2] == r[:2] for r in near)  # further columns are those of the row
    assert leaks == near


def test_no_language_and_empty_tables(spark, tmp_path):
    nothing = spark.createDataFrame([(1, frames.text(1, 60), None, "h", 1)], SCHEMA)
    assert corpus_pipeline.language(spark, nothing, "").count() == 0
    (tmp_path / "a").mkdir()
    assert staged(spark, tmp_path / "a", [(1, frames.text(1, 60)), (2, None), (3, "")], benchmark=[(1, None)])[-1][0][0] == 1
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, nothing.limit(0), "").count() == 0, name
