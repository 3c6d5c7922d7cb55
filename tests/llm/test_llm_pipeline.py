import random

import duckdb
import pytest

import corpus_pipeline
from gauntlet.llm import oracle
from gauntlet.llm.queries import QUERIES
from llm_helpers import CLASHING, docs, prose, words
from test_llm_ngram_join import brute as brute_components


def test_stages_against_their_rules(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs(spark, [(9001, None), (9002, ""), (9003, "123 456"), (9004, "the and of"), (9004, "the and of")])
    table = table.unionByName(extra.select(*table.columns))
    kept = [table]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, kept[-1], sf), f"test-{name}")
        if name != "encoding":
            assert out.dtypes == table.dtypes
        kept.append(out)
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert set(rows[0]) - set(rows[1]) == {9001, 9002, 9003}
    pairs = [(r.doc_id, r.text) for r in kept[1].collect()]
    assert set(rows[2]) == {i for i, _, c in brute_components(pairs) if i == c}
    # after the third stage no run of 50 words is in two documents (repetitive junk apart)
    first, again = {}, set()
    for i in sorted(rows[3]):
        own = words(rows[3][i].text)
        for k in range(len(own) - 49):
            run = tuple(own[k:k + 50])
            if len(set(run)) > 10 and first.setdefault(run, i) != i:
                again.add(i)
    assert not again
    assert all(set(words(rows[3][i].text)) <= set(words(rows[2][i].text)) for i in rows[3])
    bench = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i in rows[3]:
        own = " ".join(words(rows[3][i].text))
        if any(" ".join(b) in own for b in bench):
            assert i not in rows[4]
    assert set(rows[5]) == set(rows[4]) and all(r.round_trip for r in rows[5].values())
    assert [len(r.ids) for r in rows[5].values()] == [r.n_tokens for r in rows[5].values()]


def test_rows_without_an_id_or_with_a_repeated_one(spark, sf):
    rng = random.Random(26)
    stages, sample = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")

    def left(name, rows, more=None):
        table = docs(spark, rows)
        if more is not None:
            table = more.unionByName(table.select(*more.columns))
        out = stages[name](spark, table, sf)
        assert out.columns == table.columns
        return sorted(((r.doc_id, r.text) for r in out.where("doc_id IS NULL OR doc_id >= 9000").collect()), key=str)

    assert left("language_id", [(None, None), (None, ""), (None, "123 456"), (9001, "123 456"), (9001, "123 456"), (9002, None)], sample) == []
    one, two, three = (prose(rng, 80) for _ in range(3))
    assert left("near_duplicates", [(9001, one), (9001, one), (None, one), (None, two), (None, two), (9002, two), (9001, three), (None, prose(rng, 3))]
                )[:3] == sorted([(9001, one), (9002, two), (9001, three)], key=str)
    assert len(left("near_duplicates", [(None, two), (None, two), (None, three)])) == 2
    own = [prose(rng, 30) for _ in range(4)]
    got = left("repeated_passages", [(None, f"{own[0]} {one}"), (9001, f"{own[1]} {one}"), (9001, f"{one} {own[2]}"), (None, own[3])])
    assert [(i, words(t)) for i, t in got] == sorted(
        [(None, words(own[0])), (9001, words(f"{own[1]} {one}")), (9001, words(own[2])), (None, words(own[3]))], key=str)
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    assert left("decontamination", [(None, f"{own[0]} {item}"), (None, one), (9001, f"{item} {own[1]}"), (9001, two)]
                ) == sorted([(None, one), (9001, two)], key=str)
    table = docs(spark, [(None, one), (9001, one), (9001, one), (None, None)])
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in stages["encoding"](spark, table, sf).collect()) == [
        ("9001", True), ("9001", True), ("None", False), ("None", True)]


def test_filled_tables_keep_columns_with_clashing_names(spark, sf):
    rng = random.Random(8)
    one, own = prose(rng, 80), [prose(rng, 30) for _ in range(4)]
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    names = ("_row_key", "_row", "_gone", "_spans", "_id", "_ROW_id", "id", "start")
    rows = [(9001, f"{own[0]} {one}"), (9002, f"{own[1]} {one}"), (None, f"{own[2]} {item}"), (9002, f"{own[1]} {one}"), (9003, None)]
    table = spark.createDataFrame([(i, t, None, None, k, *(f"{n}{k}" for n in names)) for k, (i, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long, "
                                  + ", ".join(f"{n} string" for n in names))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns
        left[name] = {r.n_chars: r for r in out.collect()}
        for k, r in left[name].items():
            assert r.doc_id == rows[k][0] and [r[n] for n in names] == [f"{n}{k}" for n in names]
    assert 4 not in left["language_id"]
    assert set(left["near_duplicates"]) == {0, 1, 2, 4} or set(left["near_duplicates"]) == {0, 2, 3, 4}
    assert words(left["repeated_passages"][1].text) == words(own[1]) and words(left["repeated_passages"][0].text) == words(rows[0][1])
    assert set(left["decontamination"]) == {0, 1, 3, 4}


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "round_trip", "ids"] and out.count() > 100


def test_stages_on_an_empty_table(spark, sf):
    table = docs(spark, [], CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        assert out.count() == 0 and (name == "encoding" or out.columns == table.columns)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want, got = con.execute(oracle.ORACLE_SQL[name]).df(), QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = list(want.columns[:2])
    want = want.sort_values(key).reset_index(drop=True)
    got = got[want.columns].sort_values(key).reset_index(drop=True)
    for column in want.columns:
        if want[column].dtype.kind == "f":
            assert got[column].tolist() == pytest.approx(want[column].tolist(), abs=1e-6)
        else:
            assert got[column].fillna("-").tolist() == want[column].fillna("-").tolist()
