"""Media that embed whole texts: nothing after a text's first characters is lost."""

import duckdb
import pytest
from test_oracles import rows

from mediasieve.jobs.queries import QUERIES, SQL
from mediasieve.sources import fixtures as X

TEXTS = [(4, "a" * 70 + "\n" + "b c" * 50_000), (36, ""), (68, "z" * X.SEGMENT), (5, "w " * 100 + "made by comfyui"), (37, "no names"), (69, "v" * 90 + " jumbo"), (6, "\u00e9" * 200), (7, "u" * 300), (0, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith("whole_")))
def test_long_texts_match_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    result = con.execute(SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in result.description], result.fetchall())


def test_nothing_of_a_text_is_cut(spark, folder):
    got = {r.media_id: r for r in X.media(spark, folder).select("media_id", "note", "length").collect()}
    assert all(len(got[i].note) == len(t or "") for i, t in TEXTS)
    com = [r.nbytes for r in QUERIES["whole_findings"](spark, folder).where("media_id = 4 AND label = 'COM (comment)'").collect()]
    assert sorted(com) == [4 + 150_071 - 2 * X.SEGMENT, 4 + X.SEGMENT, 4 + X.SEGMENT]
    verdicts = {r.media_id: r.verdict for r in QUERIES["whole_verdicts"](spark, folder).collect()}
    assert verdicts[5] == "ai-declared" and verdicts[37] != "ai-declared"


def test_evidence_removals_and_numbers_leave_no_kind_out(spark, folder):
    named = QUERIES["whole_evidence"](spark, folder).where("label = 'Generator named in metadata'").collect()
    assert [r.media_id for r in named] == [5, 5]  # in the text and in the chunk's readable runs
    gone = {r.label: r.n for r in QUERIES["whole_removed_by_label"](spark, folder).collect()}
    assert gone["info: comment"] == 2 and gone["udta box"] == 1 and gone["JUMBF box (C2PA container)"] == 1
    assert sorted(r.number for r in QUERIES["whole_numbers"](spark, folder).collect()) == list(range(1, len(TEXTS) + 1))


def test_removals_between_files_are_those_of_cleaning(spark, folder, tmp_path):
    """By file and kind; a file without a copy has none."""
    from collections import Counter

    from pyspark.sql import functions as F

    from mediasieve.operators import clean
    from mediasieve.sources.pieces import publish

    media = X.media(spark, folder).select("path", "media_id", "container", "content")
    name = F.concat(F.col("media_id").cast("string"), F.lit("."), F.col("container")).alias("out_path")
    publish(media.select("path", name, "content"), f"file://{tmp_path}/old")
    done = clean.clean(media).join(media.drop("content"), "path").where("media_id <> 5")
    publish(done.select("path", name, F.col("cleaned").alias("content")), f"file://{tmp_path}/new")
    listed = lambda some, side: some.select(F.concat(F.lit(f"file://{tmp_path}/{side}/"), name).alias("path"), "media_id")
    got = clean.removed_between(listed(media, "old"), listed(done, "new"), "media_id").collect()
    want = clean.removed(media).join(media.select("path", "media_id"), "path").where("media_id <> 5").collect()
    assert want and Counter((r.media_id, r.kind, r.label, r.detail) for r in got) == Counter((r.media_id, r.kind, r.label, r.detail) for r in want)
