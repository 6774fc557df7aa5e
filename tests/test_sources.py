import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from crowdtide.operators import datasets as D
from crowdtide.operators import graph_build as G
from crowdtide.sources import graphs as S
from crowdtide.sources import posts as P
from crowdtide.sources.messages import read_messages
from crowdtide.functions.times import epoch_to_timestamp, parse_date


def _posts():
    return {
        f"p{i}": {
            "score": i, "selftext": 'line\n    },\n "x" }', "title": f"t{i}", "created_utc": 1.5e9 + i,
            "upvote_ratio": 0.5, "num_comments": 2,
            "author": None if i % 2 else {"name": f"n{i}", "id": f"u{i}"},
        }
        for i in range(7)
    }


@pytest.mark.parametrize("layout", ["file", "indented", "lines"])
def test_posts_by_id(spark, tmp_path, layout):
    path = tmp_path / "reddit.json"
    path.write_text(json.dumps(_posts(), indent=4 if layout == "indented" else None))
    got = {r["id"]: r for r in P.read_posts_by_id(spark, str(path), layout=layout).collect()}
    assert set(got) == set(_posts())
    for key, post in _posts().items():
        assert got[key]["selftext"] == post["selftext"] and got[key]["score"] == post["score"]
        author = got[key]["author"]
        assert (author.asDict() if author else None) == post["author"]


def test_indented_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "reddit.json"
    path.write_text(json.dumps(_posts(), indent=4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = P.read_posts_by_id(spark, str(path), layout="indented")
        assert frame.rdd.getNumPartitions() > 3
        assert sorted(r["id"] for r in frame.collect()) == sorted(_posts())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_objects(spark, tmp_path):
    for layout, text in (("file", "{}"), ("indented", "{}"), ("lines", "{}")):
        path = tmp_path / f"{layout}.json"
        path.write_text(text)
        assert P.read_posts_by_id(spark, str(path), layout=layout).count() == 0


def test_broken_objects_fail(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"x": "1", "y"')
    with pytest.raises(Exception, match="MALFORMED"):
        P.read_annotations(spark, str(path)).collect()
    with pytest.raises(ValueError, match="layout"):
        P.read_annotations(spark, str(path), layout="indented")
    path.write_text('{"x": "1"}\n\n{"y": "0"}\n')
    assert P.read_annotations(spark, str(path), layout="lines").count() == 2


def test_columnar(spark, tmp_path):
    path = tmp_path / "twitter.json"
    columns = {"ID": {"0": 12345678901234567, "1": 5}, "Content": {"0": "a", "1": "b"}, "QuotedTweet": {"0": None, "1": 7}}
    path.write_text(json.dumps(columns))
    kinds = {"ID": "string", "Content": "string", "QuotedTweet": "string"}
    got = P.read_columnar_json(spark, str(path), kinds).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "12345678901234567", "a", None), (1, "5", "b", "7")]
    path.write_text(json.dumps({**columns, "Content": {"0": "a"}}))
    with pytest.raises(Exception, match="same rows"):
        P.read_columnar_json(spark, str(path), kinds).collect()


def test_annotations(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"x": "1", "irrelevant": {"y": 1, "z": 1}, "w": "0"}))
    got = {tuple(r) for r in P.read_annotations(spark, str(path)).collect()}
    assert got == {("x", "1", False), ("y", None, True), ("z", None, True), ("w", "0", False)}


def test_removed_posts_and_unknown_labels(spark):
    posts = spark.createDataFrame([("1", "[removed]"), ("2", None), ("3", "x"), ("4", "[deleted]")], "id string, selftext string")
    assert {r["id"] for r in P.drop_removed(posts).collect()} == {"2", "3"}
    notes = spark.createDataFrame([("9", "1", False)], "id string, target string, is_irrelevant boolean")
    texts = posts.select("id", F.col("selftext").alias("text"))
    with pytest.raises(Exception, match="no post with id 9"):
        D.label_annotated(notes, texts, D.TWEET).collect()
    assert D.label_annotated(notes, texts, D.TWEET, strict=False).count() == 0


def test_annotation_merge(spark):
    notes = spark.createDataFrame([("a", "1", False)], "id string, target string, is_irrelevant boolean")
    answers = spark.createDataFrame(
        [("a", "0", 1), ("b", "3", 1), ("c", "4", 1), ("d", "1", 1), ("d", "0", 2)], "id string, answer string, answered_at int"
    )
    got = {tuple(r) for r in D.annotation_merge(notes, answers).collect()}
    assert got == {("a", "1", False), ("b", None, True), ("d", "0", False)}


def test_edge_lists(spark, tmp_path):
    csv = tmp_path / "e.csv"
    csv.write_text("id,source,target,weight\n0,a,b,1\n1,b,a,5\n2,a,b,3\n")
    got = {tuple(r) for r in S.read_edgelist(spark, str(csv)).collect()}
    assert got == {("a", "b", 3), ("b", "a", 5)}
    plain = tmp_path / "w.txt"
    plain.write_text("a b 1\nb a 5\na c 2\n")
    assert S.read_weighted_edgelist(spark, str(plain)).count() == 3
    folded = {tuple(r) for r in S.read_weighted_edgelist(spark, str(plain), directed=False).collect()}
    assert folded == {("a", "b", 5), ("a", "c", 2)}


def test_graphml_parses(spark, tmp_path):
    nodes = spark.createDataFrame([("a&b", 1.5, "x<y"), ("c", 2.0, None)], "id string, rank double, name string")
    edges = spark.createDataFrame([("a&b", "c", 3)], "source string, target string, weight long")
    S.write_graphml(nodes, edges, str(tmp_path / "g"), ["rank", "name"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = ET.fromstring(text.encode())
    space = "{http://graphml.graphdrawing.org/xmlns}"
    graph = root.find(f"{space}graph")
    assert {n.get("id") for n in graph.findall(f"{space}node")} == {"a&b", "c"}
    edge = graph.find(f"{space}edge")
    assert (edge.get("source"), edge.get("target"), edge.find(f"{space}data").text) == ("a&b", "c", "3")


def test_mail(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    mails = {
        "in/1.": "From: a@x\nTo: b@x, c@x, \n\tb@x\nCc: d@x\nBcc: d@x, e@x\n\nTo: no@x\n",
        "in/2.": "From: a@x\nX-To: Bob, c@x\r\n\r\nbody",
        "in/deep/3.": "From: a@x\nSubject: nothing\n\nTo: b@x",
    }
    for name, text in mails.items():
        (tmp_path / name).write_text(text, newline="")
    messages = read_messages(spark, str(tmp_path))
    assert messages.count() == 3
    got = {tuple(r) for r in G.email_edges(messages).collect()}
    assert got == {("a@x", "b@x", 2), ("a@x", "c@x", 2), ("a@x", "Bob", 1)}
    full = {tuple(r) for r in G.email_edges(messages, ("to", "cc", "bcc")).collect()}
    assert full == got | {("a@x", "d@x", 1), ("a@x", "e@x", 1)}
    kept = G.drop_nodes(G.email_edges(messages))
    assert {r["target"] for r in kept.collect()} == {"b@x", "c@x"}
    assert tuple(G.non_email_report(G.email_edges(messages)).first()) == (1, 1)


def test_times(spark):
    row = spark.createDataFrame([("2021-01-28", 1611792000.5)], "d string, s double").select(
        parse_date(F.col("d")), epoch_to_timestamp(F.col("s")).cast("string")
    ).first()
    assert row[0] == 1611792000 and row[1] == "2021-01-28 00:00:00.5"


def test_mentions_and_names(spark):
    tweets = spark.createDataFrame([("u1", "@ann @ann @ghost @a_name_that_is_long")], "UserID string, Content string")
    users = spark.createDataFrame([("7", "Ann")], "id string, Username string")
    got = {tuple(r) for r in G.accumulate_weights(G.mention_edges(tweets, users)).collect()}
    assert got == {("u1", "7", 2), ("u1", "a_name_that_is_long", 1)}
    ids = spark.createDataFrame([("7",), ("8",), ("9",), ("bob",)], "id string")
    people = spark.createDataFrame([("7", "Ann", "Ann A")], "id string, Username string, Name string")
    named = {r["id"]: (r["Username"], r["Name"]) for r in G.resolve_users(ids, people).collect()}
    assert named == {"7": ("Ann", "Ann A"), "8": ("Unknown#1",) * 2, "9": ("Unknown#2",) * 2, "bob": ("bob", "bob")}
    with pytest.raises(Exception, match="no name for node"):
        G.rename_nodes(spark.createDataFrame([("7", "8", 1)], "source string, target string, weight long"), people).collect()
