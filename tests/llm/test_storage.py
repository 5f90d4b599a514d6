"""Where the operators write what they read again."""

import cases
import pytest

from claimloom.llm import queries, storage


@pytest.fixture
def cluster(spark, monkeypatch):
    """Makes the session say that it runs on a cluster, with this checkpoint folder."""

    def named(folder):
        get = type(spark.conf).get
        monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:1")
        monkeypatch.setattr(
            type(spark.conf), "get", lambda conf, key, *a: folder if key == "spark.checkpoint.dir" else get(conf, key, *a)
        )
        return spark

    return named


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_the_checkpoint_folder_is_taken_as_it_is_named(cluster, tmp_path, scheme):
    spark = cluster(f"{scheme}{tmp_path}/")
    back = storage.stored(spark.range(3), "t")
    assert sorted(r.id for r in back.collect()) == [0, 1, 2] and list(tmp_path.glob("t-*"))
    assert storage.new_path(spark, "t").startswith(f"{scheme}{tmp_path}/t-")


def test_a_cluster_without_a_checkpoint_folder_is_refused(cluster):
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_root(cluster(None))


QUERIES = [
    "op1_simhash",
    "op5_mixing",
    "op7_tokens",
    "op8_lines",
    "op9_urls",
    "op10_topk",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    single = {r[0]: r for r in cases.ROWS if r[0] is not None}
    made = {
        "documents": cases.documents(spark, list(single.values())),
        "pages": spark.range(60).selectExpr(
            "id AS page_id", "concat('http://www.example.', if(id % 3 = 0, 'net', 'com'), '/', if(id % 2 = 0, 'en', 'es'), '/', id % 5) AS url", "'' AS html"
        ),
        "labels": spark.range(60).selectExpr("id AS doc_id", "id % 2 AS quality", "id % 7 % 2 AS toxic"),
        "embeddings": spark.range(150).selectExpr("id AS vec_id", "transform(sequence(1, 8), k -> cast(sin(id * k) AS float)) AS embedding"),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_a_query_goes_on_from_a_folder_named_without_a_scheme(cluster, tables, tmp_path, monkeypatch, name):
    plain, whole = [
        cases.rows(queries.queries()[name](cluster(folder), tables)) for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b")
    ]
    assert plain and plain == whole
    assert list((tmp_path / "a").iterdir())
