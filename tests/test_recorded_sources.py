"""Recorded pages and event streams: stop rules, items seen before, restarts."""

import json

from quern.sources import files


def pages(tmp_path, bodies):
    folder = tmp_path / "pages"
    folder.mkdir()
    for name, body in bodies.items():
        (folder / name).write_text(body if isinstance(body, str) else json.dumps({"items": body}))
    return str(folder)


def test_pages_stop_and_items_count_once(spark, tmp_path):
    item = lambda **k: {"id": None, "url": None, "title": None, "summary": "s"} | k
    folder = pages(tmp_path, {
        "page-1.json": [item(id="1", url="u1", title="a"), item(id="2", url=" ", title="b"), item(id="9", url="u1", title="other")],
        "page-2.json": [item(id="2", title="again"), item(title="b"), item(title="b "), item(), item(), item(id="3", url="u3")],
        "page-3.json": [item(id="4", url="u4")], "page-4.json": [], "page-5.json": [item(id="5", url="u5")],
    })
    got = [(r["page"], r["position"], r["id"], r["url"], r["title"]) for r in files.read_pages(spark, folder).orderBy("page", "position").collect()]
    assert got == [(1, 0, "1", "u1", "a"), (1, 1, "2", " ", "b"), (2, 1, None, None, "b"), (2, 3, None, None, None), (2, 4, None, None, None), (2, 5, "3", "u3", None), (3, 0, "4", "u4", None)]
    assert {r["page"] for r in files.read_pages(spark, folder, most=2).collect()} == {1, 2}


def test_pages_with_gaps_or_without_sense(spark, tmp_path):
    folder = pages(tmp_path, {"p1.json": [{"id": "1"}], "p3.json": [{"id": "3"}], "p2.json": "no json"})
    assert [r["id"] for r in files.read_pages(spark, folder).collect()] == ["1"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("{}")
    assert files.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_event_streams(spark, tmp_path):
    (tmp_path / "a.txt").write_text('event: x\ndata: {"delta": "Hel"}\n\ndata:{"choices": [{"delta": {"content": "lo"}}]}\ndata: {"usage": 3}\ndata: [DONE]\ndata: {"delta": "late"}\n')
    (tmp_path / "b.txt").write_text('data: {"delta": "cut"}\ndata: {"delta": " off\\n"}\n: a remark\n')
    (tmp_path / "c.txt").write_text("nothing here\n")
    got = {r["file"]: (r["answer"], r["events"], r["done"]) for r in files.read_events(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("Hello", 2, True), "b.txt": ("cut off\n", 2, False)}


def test_event_lines_as_a_stream_restart(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()

    def run():
        live = files.event_parts(spark.readStream.text(str(src))).select("kind", "delta")
        live.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()

    (src / "1.txt").write_text('data: {"delta": "a"}\nid: 1\n')
    run()
    (src / "2.txt").write_text('data: {"delta": "b"}\ndata: [DONE]\n')
    run()
    run()
    assert sorted((r["kind"], str(r["delta"])) for r in spark.read.parquet(out).collect()) == [("delta", "a"), ("delta", "b"), ("done", "None")]
