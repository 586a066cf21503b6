"""Restores, exports, stages that are resumed, inventories of files."""

import json
import os

import pytest

from reelspan import phases
from reelspan.sources import manifests, moves


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path


def test_restore_plan_and_move(spark, tmp_path):
    project, review, picked = tmp_path / "trip", tmp_path / "trip" / "work" / "review", tmp_path / "trip" / "work" / "picked"
    names = {"a b.jpg": b"1", "deep/c%20d.mov": b"22", "ü.png": b""}
    for name, content in names.items():
        put(review / "set1" / name, content)
    put(picked / "set2" / "x.jpg", b"3")
    put(review / "loose.jpg", b"4")
    plan = moves.restore_plan(spark, str(project), [str(review), f"file://{picked}", str(tmp_path / "missing")])
    rows = {r.source.rpartition("/")[2]: (r.destination, r.conflict) for r in plan.collect()}
    assert rows["loose.jpg"] == (None, "no_media_set") and rows["x.jpg"] == (f"file://{project}/x.jpg", None) and rows["c%20d.mov"][0] == f"file://{project}/deep/c%20d.mov"
    with pytest.raises(FileExistsError, match="no_media_set"):
        moves.carry_out(plan, away=True)
    assert (review / "set1" / "a b.jpg").exists() and not (project / "x.jpg").exists()  # nothing was touched
    generated = put(tmp_path / "trip" / "work" / "report.csv", b"r")
    assert [r.path for r in moves.cleanup_plan(spark, [str(project / "work")], plan).collect()] == [f"file://{generated}"]
    (review / "loose.jpg").unlink()
    put(review / "set9" / "x.jpg", b"5")
    assert {r.conflict for r in moves.restore_plan(spark, str(project), [str(review), str(picked)]).where("destination like '%x.jpg'").collect()} == {"twice"}
    (review / "set9" / "x.jpg").unlink()
    plan = moves.restore_plan(spark, str(project), [str(review), str(picked)])
    kept = plan.collect()
    assert {r.outcome for r in moves.carry_out(plan, away=True).collect()} == {"moved"}
    assert all((project / name).read_bytes() == content for name, content in names.items()) and not (review / "set1" / "a b.jpg").exists()
    again = spark.createDataFrame([tuple(r) for r in kept], plan.schema)
    assert {r.outcome for r in moves.carry_out(again, away=True).collect()} == {"done"}  # a task that runs twice
    assert moves.removed(moves.cleanup_plan(spark, [str(project / "work")], again)) == 1 and not generated.exists()
    put(review / "set1" / "a b.jpg", b"other")
    assert [r.conflict for r in moves.restore_plan(spark, str(project), [str(review)]).collect()] == ["exists"]


def test_export_copies_what_differs(spark, tmp_path):
    root, target = tmp_path / "in", tmp_path / "out"
    for i in range(12):
        put(root / f"{i}.jpg", bytes([i]) * (1 + i))
    put(target / "album" / "0.jpg", bytes([0]))
    put(target / "album" / "1.jpg", b"xx")  # as long, but another file
    chosen = spark.createDataFrame([(f"{i}.jpg", f"album/{i}.jpg") for i in range(12)] + [("0.jpg", "album/0.jpg")], "source string, destination string")
    plan = moves.export_plan(spark, chosen, str(root), str(target))
    assert {r.destination.rpartition("/")[2]: r.conflict for r in plan.collect() if r.conflict} == {"0.jpg": "identical", "1.jpg": "differs"}
    with pytest.raises(FileExistsError, match="differs"):
        moves.carry_out(plan)
    assert sorted(os.listdir(target / "album")) == ["0.jpg", "1.jpg"]
    done = moves.carry_out(moves.export_plan(spark, chosen, str(root), str(target), overwrite=True))
    assert done.count() == 11 and all((target / "album" / f"{i}.jpg").read_bytes() == bytes([i]) * (1 + i) for i in range(12))
    assert moves.export_plan(spark, chosen, str(root), str(target)).where("conflict <> 'identical' or conflict is null").count() == 0
    odd = spark.createDataFrame([("none.jpg", "a"), ("2.jpg", "b"), ("3.jpg", "b")], "source string, destination string")
    assert sorted(r.conflict for r in moves.export_plan(spark, odd, str(root), str(target)).collect()) == ["missing", "twice", "twice"]


CONFIG = {"modules": {"story_builder": {"enabled": True}, "album_builder": {"enabled": True}, "inventory": {"enabled": True}}}


def test_stages_are_resumed(spark, tmp_path):
    """What has been done for the same tables, settings and earlier stages is not done again; a change of settings redoes it and what depends on it."""
    tables, out, written = "/root/testdata/sf0.001", f"file://{tmp_path}/out", []

    def write(df, path):
        written.append(path.rpartition("/")[2])
        if fail and path.endswith(fail[0]):
            raise OSError("disk")
        manifests.write_manifest(df, path)

    def run(config, resume=True, only=("story-builder", "album-builder")):
        written.clear()
        return dict(phases.run(spark, tables, out, config, only=only, execute=True, resume=resume, write=write))

    fail = ["story_beats"]
    with pytest.raises(OSError):
        run(CONFIG)
    fail.clear()
    assert run(CONFIG) == {"story-builder": "done", "album-builder": "done"}
    assert "moments_sessionize" not in written and "story_beats" in written and "album_variants" in written  # it goes on where it broke off
    assert run(CONFIG) == {"story-builder": "kept", "album-builder": "kept"} and not written
    changed = json.loads(json.dumps(CONFIG))
    changed["album_builder"] = {"sizes": 3}
    assert run(changed) == {"story-builder": "kept", "album-builder": "done"} and "moments_sessionize" not in written
    changed["story_builder"] = {"gap": 3}
    assert run(changed) == {"story-builder": "done", "album-builder": "done"}  # albums need stories
    assert run(changed, resume=False, only=("story-builder",)) == {"story-builder": "done"}


def test_inventory_of_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"
    for name in ("raft/a.png", "raft/deep/b.PNG", "hike/c.png", "hike/notes.txt", "off/d.png"):
        put(tmp_path / name, png)
    config = {"modules": {"inventory": {"enabled": True}}, "media_root": str(tmp_path), "media_sets": {"raft": {}, "hike": {}, "off": {"enabled": False}}}
    assert phases.run(spark, "/root/testdata/sf0.001", f"file://{tmp_path}/out", config, only=["inventory"], execute=True) == [("inventory", "done")]
    found = manifests.read_manifest(spark, f"file://{tmp_path}/out/01_inventory/media_inventory", "media_set string, relative_path string, kind string, width int, height int, created timestamp").collect()
    assert sorted((r.media_set, r.relative_path, r.width, r.height) for r in found) == [("hike", "c.png", 640, 480), ("raft", "a.png", 640, 480), ("raft", "deep/b.PNG", 640, 480)] and all(r.created for r in found)


def test_plain_settings_know_lists():
    text = """---
modules:
  inventory: {}
  album_builder:
    enabled: yes   # a comment
    types: [peak, "group_photo", 3]
    important:
      - arrival
      - 2.5
    same_depth:
    - a
    - no
sets:
  - name: raft
    folders:
      - one
      - two
  -
    name: "hike: long"
empty:
last: off
"""
    found = manifests._plain(text)
    assert found["modules"]["album_builder"] == {"enabled": True, "types": ["peak", "group_photo", 3], "important": ["arrival", 2.5], "same_depth": ["a", False]}
    assert found["sets"] == [{"name": "raft", "folders": ["one", "two"]}, {"name": "hike: long"}] and found["empty"] == {} and found["last"] is False
    assert manifests._plain("") == {} and manifests._plain("odd line\n  deeper: 1\nkey: 2") == {"key": 2, "deeper": 1}
