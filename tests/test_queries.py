"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import queries


def rows(frame):
    def plain(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if v is None or v != v:
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    kinds = {c: k for c, k in zip(want.columns, want.dtypes, strict=True)}
    for c, k in kinds.items():
        if k.kind in "iuf":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_hybrid_search_finds_documents_without_a_vector(spark, tmp_path):
    """The best texts by words have no vector; one of them says its heading late."""
    text = "filler " * 40 + "the and"
    rows = [(i, text if i >= 20 else "nothing of it", "en", "x", 9) for i in range(30)]
    rows[25] = (25, text + "\n# the and", "en", "x", 9)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<float>")
    vectors.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("hybrid_search", "banks_merged"):
        got = [r["id"] for r in queries.QUERIES[name](spark, str(tmp_path)).where("query_id = 0").collect()]
        assert any(i >= 20 for i in got) and 25 in got


def many(spark, n):
    import random

    source = random.Random(1)
    rows = [(i, [source.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_neighbours_of_any_number_of_queries(spark, monkeypatch):
    """More query vectors than a pass or a task's block takes find the same as all at once."""
    from plumbline.operators import retrieval

    vectors = many(spark, 90)
    asked = vectors.withColumnRenamed("id", "query_id")

    def found():
        return sorted((r["query_id"], r["vec_rank"], r["id"], round(r["distance"], 9) + 0.0) for r in retrieval.knn(vectors, asked, 5).collect())

    want = found()
    assert len(want) == 450
    for floats, products, rows in ((40, 4_000_000, 4096), (8_000_000, 21, 7), (4, 10, 3)):
        monkeypatch.setattr(retrieval, "PASS_FLOATS", floats)
        monkeypatch.setattr(retrieval, "TASK_PRODUCTS", products)
        monkeypatch.setattr(retrieval, "ROWS", rows)
        assert found() == want


def test_search_skips_only_what_cannot_be_among_the_best(spark, tmp_path, monkeypatch):
    """Ranks equal those of a search that scores all, phrases and other syntax included, and most postings are not scored."""
    import random

    from plumbline.operators import lexical, postings
    from plumbline.operators.postings import TextIndex

    source = random.Random(5)
    texts = [(i, " ".join(source.choice("alpha beta gamma delta epsilon zeta of the".split()) for _ in range(source.randrange(3, 90))), "alpha" if i % 9 == 0 else None) for i in range(900)]
    texts += [(900, None, None), (901, "", "beta"), (901, "alpha beta", ""), (None, "alpha", None)]
    table = spark.createDataFrame(texts, "id long, content string, heading_context string").repartition(3)
    index = TextIndex.build(table, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "gamma OR zeta"), (3, "alpha NOT beta"), (4, "of_the"), (5, "of_the AND alpha"), (6, "nothing"), (7, "alpha alpha")], "query_id long, query string")
    got = [tuple(r) for r in lexical.bm25(index, asked, 5).orderBy("query_id", "bm25_rank").collect()]
    work = {r["query_id"]: r for r in lexical.work(index, asked, 5).collect()}
    every = lexical.bm25(index, asked, 5000).where("bm25_rank <= 5").orderBy("query_id", "bm25_rank").collect()
    assert got == [tuple(r) for r in every] and {g[0] for g in got} == {1, 2, 3, 4, 5, 7}
    assert sum(w["scored"] for w in work.values()) < 0.6 * sum(w["postings"] for w in work.values())
    plan = lexical.bm25(index, asked, 5)._jdf.queryExecution().toString()
    assert "content" not in plan and "PushedFilters: [In(term" in plan
    assert "In(span" in plan  # spans are read by name, too
    for name, value in (("NAMED", 1), ("HANDED", 2)):  # more than can be named in a filter, then more than goes to all tasks
        monkeypatch.setattr(postings, name, value)
        assert [tuple(r) for r in lexical.bm25(index, asked, 5).orderBy("query_id", "bm25_rank").collect()] == got
    monkeypatch.undo()
    none = TextIndex.build(table.limit(0), str(tmp_path / "none"))
    assert lexical.bm25(none, asked, 5).count() == 0


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_an_index_is_built_where_texts_lie(spark, tmp_path, monkeypatch):
    """No text or posting is shuffled; rows hold all words with places, over several runs of a task; any number of terms is named in filters."""
    import random

    from plumbline.operators import lexical, postings
    from plumbline.operators.postings import TextIndex

    source = random.Random(7)
    texts = [(i, " ".join(f"w{source.randrange(400)}" for _ in range(source.randrange(120))), "w1 title" if i % 7 == 0 else None) for i in range(1, 1200)]
    texts.append((0, None, None))
    table = spark.createDataFrame(texts, "id long, content string, heading_context string").repartition(8)
    table.write.parquet(str(tmp_path / "texts"))
    before = shuffled(spark)
    index = TextIndex.build(spark.read.parquet(str(tmp_path / "texts")), str(tmp_path / "index"))
    assert shuffled(spark) == before
    want = set()
    for i, text, heading in texts:
        want |= {(i, w, at) for at, w in enumerate([*(text or "").split(), "", *(heading or "").split()]) if w}
    rows = index.postings.where("term IS NOT NULL").join(index.spans, "span").selectExpr("term", "ids", "lens", "tf", "tops", "explode(arrays_zip(slots, positions)) x").collect()
    assert {(r["ids"][r["x"]["slots"]], r["term"], at) for r in rows for at in r["x"]["positions"]} == want
    assert index.corpus().first()["n_docs"] == 1200 and len(want) == sum(len(r["x"]["positions"]) for r in rows)
    asked = spark.createDataFrame([(1, " OR ".join(f"w{i}" for i in range(25)))], "query_id long, query string")
    found = lexical.bm25(index, asked, 9)
    assert "PushedFilters: [Or(Or(In(term" in found._jdf.queryExecution().toString()
    few = [tuple(r) for r in found.orderBy("bm25_rank").collect()]
    monkeypatch.setattr(postings, "RUN_BYTES", 900)
    assert few == [tuple(r) for r in lexical.bm25(TextIndex.build(table, str(tmp_path / "runs")), asked, 9).orderBy("bm25_rank").collect()]


def test_chunks_are_indexed_without_shuffling_texts(spark, tmp_path):
    """Vectors meet headings alone; an id with several vectors is as many chunks, by words too."""
    rows = [(i, f"# head{i}\n" + " ".join(f"word{i * 1000 + j}" for j in range(1000)), "en", "x", 9) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = lambda ids: spark.createDataFrame([(i, [1.0, float(i or 0)]) for i in ids], "vec_id long, embedding array<float>")
    vectors(range(50)).write.parquet(str(tmp_path / "embeddings.parquet"))
    before = shuffled(spark)
    _, index = queries.chunk_index(spark, str(tmp_path))
    assert shuffled(spark) - before < sum(len(r[1]) for r in rows) / 50
    assert index.corpus().first()["n_docs"] == 200
    vectors([7, 7, None]).write.mode("append").parquet(str(tmp_path / "embeddings.parquet"))
    chunks, index = queries.chunk_index(spark, str(tmp_path), "id IS NOT NULL AND id < 100")
    assert chunks.count() == index.corpus().first()["n_docs"] == 102 and chunks.where("id = 7").count() == 3


def test_partitions_are_skipped_and_nothing_is_missed(spark, tmp_path, monkeypatch):
    """Clusters: neighbours equal those of the whole scan, in blocks of queries too, and most partitions and rows are not looked at."""
    import numpy as np

    from plumbline.errors import ConfigError
    from plumbline.operators import pivots, retrieval
    from plumbline.operators.pivots import VectorIndex

    source = np.random.default_rng(3)
    centers = source.normal(size=(12, 8))
    rows = [(i, (centers[i % 12] + source.normal(size=8) * 0.02).tolist()) for i in range(600)]
    odd = [(600, None), (None, rows[0][1]), (601, [0.0] * 8), (602, rows[5][1]), (602, rows[5][1])]
    vectors = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(4)
    asked = vectors.where("id % 20 = 0 OR id > 600").select(F.col("id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    index = VectorIndex.build(vectors, str(tmp_path / "index"), 12)

    def plain(found):
        return sorted((r["query_id"], r["vec_rank"], round(r["distance"], 9) + 0.0) for r in found.collect())

    want = retrieval.knn(vectors, asked.where("query_id <> 601"), 7)
    for floats in (pivots.PASS_FLOATS, 60):
        monkeypatch.setattr(pivots, "PASS_FLOATS", floats)
        found, work = index.search(asked, 7)
        assert plain(found) == plain(want)
        w = work.first()
        assert w["pairs_read"] < 0.25 * w["pairs"] and 0 < w["rows_compared"] < 0.2 * w["rows"]
    assert index.search(asked.limit(0), 7)[0].count() == 0
    none = VectorIndex.build(vectors.limit(0), str(tmp_path / "none"))
    assert none.search(asked, 7)[0].count() == 0
    with pytest.raises(ConfigError):
        index.search(asked.withColumn("embedding", F.slice("embedding", 1, 3)), 7)
