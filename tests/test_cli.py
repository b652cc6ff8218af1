import io
import json

import numpy as np

from pagemill import cli
from pagemill.functions.page import BW1, Page
from pagemill.plans import profile
from pagemill.sources.codecs import tiff


def test_verbs(spark, tmp_path):
    def say(*args, code=0):
        out = io.StringIO()
        assert cli.run(spark, ["--store", str(tmp_path / "store"), *args], out) == code
        return out.getvalue().strip()

    say("migrate")
    one = say("submit", "/a.tif", "--priority", "3", "--due", "2024-01-02T00:00:00Z", "--tag", "x")
    two = say("submit", "/b.tif")
    assert [line.split("\t")[0] for line in say("list").splitlines()] == [one, two]
    say("tag", two, "y")
    say("prioritize", two, "9")
    say("fail", "nobody", "why", code=1)
    assert json.loads(say("report"))["submitted"] == 2 and [j["id"] for j in json.loads(say("export", "--tag", "y"))] == [two]
    assert say("run-next") == f"{two}\tcompleted" and say("run-next", "--fail", "jam", "--continue") == f"{one}\texception"
    say("retry", one)
    (tmp_path / "p.policy").write_text("overdue=40")
    say("rebalance", str(tmp_path / "p.policy"))
    assert json.loads(say("export", "--state", "submitted"))[0]["priority"] == 40
    (tmp_path / "jobs.json").write_text(say("export"))
    assert len(say("import", str(tmp_path / "jobs.json")).splitlines()) == 2 and json.loads(say("report"))["total"] == 4
    assert say("purge", "completed", "2999-01-01T00:00:00", "--dry-run") == "1" and json.loads(say("report"))["total"] == 4


def test_process_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    px = np.zeros((60, 80), np.uint8)
    px[10:40, 10:60] = 1
    (tmp_path / "in" / "a.tif").write_bytes(tiff.write([Page(px, BW1, 300, 300)] * 2, tiff.LZW))
    p = profile.profile(canvas={"preset": "autodetect"}, output={"output_directory": str(tmp_path / "out"), "raster_format": "ccitt4", "conflict_policy": "overwrite"})
    (tmp_path / "p.json").write_text(profile.to_json(p))
    out = io.StringIO()
    assert cli.run(spark, ["--store", str(tmp_path / "s"), "process", str(tmp_path / "in"), str(tmp_path / "p.json")], out) == 0
    assert json.loads(out.getvalue())["succeeded"] == 2
    done = [tiff.read_page((tmp_path / "out" / n).read_bytes()) for n in ("a.tif", "a_2.tif")]
    assert all(d.pixels.sum() == 1500 and d.pixels.shape == (60, 80) for d in done)


def test_lists_conflicts_and_unreadable_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    px = np.zeros((60, 80), np.uint8)
    px[10:40, 10:60] = 1
    for name in ("a.tif", "b.TIF"):
        (tmp_path / "in" / name).write_bytes(tiff.write([Page(px, BW1, 300, 300)], tiff.LZW))
    (tmp_path / "in" / "c.bmp").write_bytes(b"no image")
    (tmp_path / "in" / "d.txt").write_text("not listed")
    p = profile.profile(canvas={"preset": "autodetect"}, output={"output_directory": str(tmp_path / "out"), "raster_format": "lzw", "conflict_policy": "report"})
    (tmp_path / "p.json").write_text(profile.to_json(p))
    run = lambda: cli.run(spark, ["--store", str(tmp_path / "s"), "process", str(tmp_path / "in"), str(tmp_path / "p.json"), "--good-list", str(tmp_path / "good.json"), "--exception-list", str(tmp_path / "bad.json")], io.StringIO())
    assert run() == 1
    good, bad = (json.loads((tmp_path / n).read_text()) for n in ("good.json", "bad.json"))
    assert (good["total_processed"], good["succeeded"], bad["total_exceptions"]) == (3, 2, 1) and bad["files"][0]["error"] == "cannot read image"
    assert {f["output"].rpartition("/")[2] for f in good["files"]} == {"a.tif", "b.tif"} and all(f["elapsed_ms"] >= 0 and f["step_details"][0]["name"] == "rotate" for f in good["files"])
    assert run() == 1
    bad = json.loads((tmp_path / "bad.json").read_text())
    assert bad["total_exceptions"] == 3 and sum(f["error"].startswith("output file already exists") for f in bad["files"]) == 2


def test_rebalance_options(spark, tmp_path):
    def say(*args):
        out = io.StringIO()
        assert cli.run(spark, ["--store", str(tmp_path / "store"), "--events", str(tmp_path / "events"), *args], out) == 0
        return out.getvalue().strip()

    one, two = say("submit", "/a.tif", "--due", "2024-01-02T00:00:00"), say("submit", "/b.tif", "--due", "2999-01-02T00:00:00")
    say("rebalance", "--within-minutes", "999999999", "7", "--overdue", "30")
    assert {j["id"]: j["priority"] for j in json.loads(say("export"))} == {one: 30, two: 7}
    assert say("run-next", "--continue").splitlines() == [f"{one}\tcompleted", f"{two}\tcompleted"]
    events = [(r.job_id, r.state) for r in spark.read.json(str(tmp_path / "events")).collect()]
    assert events.count((two, "completed")) == 1 and events.count((one, "validating")) == 1 and events.count((one, "submitted")) == 2
