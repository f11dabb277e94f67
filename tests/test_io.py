"""Exchanged formats: bytes as the consumers read them, and round trips through a fresh folder."""

import json
import os

import pytest

from irforge.sources import readers as rd
from irforge.sources import sinks as sk


def lines(path):
    out = []
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8", newline="") as fh:
                out += fh.read().split("\n")[:-1]
    return out


def test_trec_run_and_qrels_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("q1", "d1", 1, 2.5), ("q1", "d2", 2, 1.25)], "qid string, docid string, rank int, score double")
    sk.write_trec_run(run, f"{tmp_path}/run")
    assert sorted(lines(f"{tmp_path}/run")) == ["q1 Q0 d1 1 2.5 irforge", "q1 Q0 d2 2 1.25 irforge"]
    assert sorted(tuple(r) for r in rd.read_trec_run(spark, f"{tmp_path}/run").collect()) == [("q1", "d1", 1, 2.5), ("q1", "d2", 2, 1.25)]
    sk.write_qrels(spark.createDataFrame([("q1", "d1", 1)], "qid string, docid string, rel int"), f"{tmp_path}/qrels")
    assert lines(f"{tmp_path}/qrels") == ["q1 0 d1 1"]
    assert [tuple(r) for r in rd.read_qrels(spark, f"{tmp_path}/qrels").collect()] == [("q1", "d1", 1)]


def test_rerank_train_labels_are_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("q1", 0, "what?", "doc \"a\"\n\\ é", 1.0), ("q1", 1, "what?", "neg", 0.0), ("q2", 0, "", None, 1.0)],
                                 "qid string, neg_no long, query string, doc string, label double")
    sk.write_rerank_train(rows, f"{tmp_path}/train")
    parsed = [json.loads(x) for x in lines(f"{tmp_path}/train")]
    assert parsed == [["what?", "doc \"a\"\n\\ é", 1.0], ["what?", "neg", 0.0], ["", "", 1.0]]
    assert [type(p[2]) for p in parsed] == [float] * 3 and [p[2] == 1.0 for p in parsed] == [True, False, True]
    back = sorted(tuple(r) for r in rd.read_rerank_train(spark, f"{tmp_path}/train").collect())
    assert back == sorted(tuple(p) for p in parsed)


def test_tab_separated_files_are_raw(spark, tmp_path):
    topics = spark.createDataFrame([("1", 'what is "x" \\ y'), ("2", ""), ("3", "a\tb\nc"), ("4", None)], "qid string, query string")
    sk.write_topics_tsv(topics, f"{tmp_path}/topics")
    assert sorted(lines(f"{tmp_path}/topics")) == ['1\twhat is "x" \\ y', "2\t", "3\ta b c", "4\t"]
    sk.write_collection_tsv(topics.withColumnsRenamed({"qid": "docid", "query": "doctext"}), f"{tmp_path}/collection")
    assert lines(f"{tmp_path}/collection") == lines(f"{tmp_path}/topics")
    sk.write_triples(spark.createDataFrame([("q\tx", "p\nline", "n \"z\"")], "query string, positive string, negative string"), f"{tmp_path}/triples")
    assert lines(f"{tmp_path}/triples") == ['q x\tp line\tn "z"']


def test_nested_testset_reads_back_whole(spark, tmp_path):
    rows = [(f"q{i}", (f"title {i}",), [(f"d{i}", "text\nwith \"quotes\""), ("e", "")]) for i in range(5)]
    nested = spark.createDataFrame(rows, "qid string, qtext struct<title:string>, passages array<struct<docid:string,text:string>>")
    sk.write_nested_testset(nested.coalesce(1), f"{tmp_path}/nested")
    want = sorted((q, t[0], [tuple(p) for p in ps]) for q, t, ps in rows)
    plain = lambda df: sorted((r.qid, r.qtext.title, [tuple(p) for p in r.passages]) for r in df.collect())
    assert plain(rd.read_nested_testset(spark, f"{tmp_path}/nested")) == want
    sk.write_nested_testset(nested.repartition(3), f"{tmp_path}/several")
    assert plain(rd.read_nested_testset(spark, f"{tmp_path}/several")) == want
    os.makedirs(f"{tmp_path}/array")
    with open(f"{tmp_path}/array/a.json", "w") as fh:
        json.dump([{"qid": q, "qtext": {"title": t[0]}, "passages": [list(p) for p in ps]} for q, t, ps in rows], fh, indent=1)
    assert plain(rd.read_nested_testset(spark, f"{tmp_path}/array")) == want


def test_last_generated_question_wins_over_files(spark, tmp_path):
    from pyspark.sql import functions as F
    with open(f"{tmp_path}/a.jsonl", "w") as fh:
        fh.write("".join(json.dumps({"docid": "d", "doctext": "t", "question": f"first {i}" + "x" * 2000}) + "\n" for i in range(200)))
    with open(f"{tmp_path}/b.jsonl", "w") as fh:
        fh.write(json.dumps({"docid": "d", "doctext": "t", "question": "second"}) + "\n")
    q = rd.read_generated_questions(spark, str(tmp_path))
    assert q.groupBy("docid").agg(F.max_by("question", "seq").alias("q")).first()["q"] == "second"
    assert q.groupBy("docid").agg(F.min_by("question", "seq").alias("q")).first()["q"].startswith("first 0x")


def test_prompt_template_by_key(spark, tmp_path):
    path = f"{tmp_path}/t.yaml"
    with open(path, "w") as fh:
        fh.write("1-shot:\n  template: |\n    One {document}\n      deeper\n\n    {query}\n3-shot:\n  other: x\n  template: |\n    Three: {query}\nflat: |\n  Flat {query}\n")
    assert rd.read_prompt_template(spark, path, "1-shot") == "One {document}\n  deeper\n\n{query}\n"
    assert rd.read_prompt_template(spark, path, "3-shot") == "Three: {query}\n"
    assert rd.read_prompt_template(spark, path, "flat") == "Flat {query}\n"
    with pytest.raises(KeyError):
        rd.read_prompt_template(spark, path, "5-shot")


def test_step_log_appends_and_sorted_ids(spark, tmp_path):
    for step in (1, 2):
        sk.append_step_log(spark.createDataFrame([(step, 0.5)], "step int, score double"), f"{tmp_path}/log")
    assert sorted(r.step for r in spark.read.json(f"{tmp_path}/log").collect()) == [1, 2]
    sk.write_sorted_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "docid string"), f"{tmp_path}/ids")
    assert lines(f"{tmp_path}/ids") == ["a", "b", "c"]
    sk.write_metrics_csv(spark.createDataFrame([("x", "ndcg@10", 0.5), ("x", "mrr@10", 1.0)], "dataset string, metric string, value double"), f"{tmp_path}/m")
    assert lines(f"{tmp_path}/m") == ["dataset,ndcg@10,map@100,recall@100,mrr@10", "x,0.5,,,1.0"]


def test_topics_join_integer_fallback(spark):
    run = spark.createDataFrame([("007", "d"), ("8", "e")], "qid string, docid string")
    topics = spark.createDataFrame([("7", "seven"), ("8", "eight")], "qid string, query string")
    assert sorted((r["qid"], r["query"]) for r in rd.topics_join(run, topics).collect()) == [("007", "seven"), ("8", "eight")]


def test_beir_and_raw_fields(spark, tmp_path):
    with open(f"{tmp_path}/c.jsonl", "w") as fh:
        fh.write('{"_id": "1", "title": "T", "text": "x"}\n{"_id": "2", "text": "y"}\n')
    with open(f"{tmp_path}/q.jsonl", "w") as fh:
        fh.write('{"_id": "q", "text": "what"}\n')
    with open(f"{tmp_path}/r.tsv", "w") as fh:
        fh.write("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    c, q, r = rd.read_beir(spark, f"{tmp_path}/c.jsonl", f"{tmp_path}/q.jsonl", f"{tmp_path}/r.tsv")
    assert sorted(tuple(x) for x in c.collect()) == [("1", "T", "x"), ("2", "", "y")]
    assert [tuple(x) for x in q.collect()] == [("q", "what")] and [tuple(x) for x in r.collect()] == [("q", "1", 1)]
    raw = spark.createDataFrame([('{"title": "a \\"b\\"", "text": "t"}',), ("{}",)], "raw string")
    assert [(x.title, x.text) for x in rd.raw_doc_fields(raw).collect()] == [('a "b"', "t"), ("", "")]
