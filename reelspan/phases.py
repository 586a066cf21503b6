"""The phases of a curation run: their order and gates, and what each of them runs and writes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import QUERIES
from .sources import manifests, media, media_sets, scratch

VERSION = 3  # of the rules; another one makes every stage new


@dataclass(frozen=True)
class Phase:
    number: int
    command: str
    title: str
    outputs: tuple[str, ...]  # the queries whose results are its manifests
    needs: tuple[str, ...] = ()  # the phases whose results these rest on

    @property
    def key(self) -> str:
        return self.command.replace("-", "_")

    @property
    def folder(self) -> str:
        return f"{self.number:02d}_{self.key}"


PHASES = (
    Phase(1, "inventory", "Inventory", ("inventory_scan", "capture_index")),
    Phase(2, "duplicate-detection", "Duplicate detection", ("duplicate_groups", "best_record", "near_duplicate_groups", "duplicate_contract"), ("inventory",)),
    Phase(3, "quality-scoring", "Quality scoring", ("technical_scores", "purpose_outputs", "quality_selection"), ("inventory", "duplicate-detection")),
    Phase(5, "story-builder", "Story builder", ("moments_sessionize", "target_moments", "moment_aggregates", "story_beats"), ("quality-scoring",)),
    Phase(6, "album-builder", "Album builder", ("album_variants", "album_candidates", "album_selection", "cover_and_closing"), ("story-builder", "quality-scoring")),
    Phase(7, "video-processing", "Video processing", ("scene_boundaries", "clip_scoring", "audio_events", "processing_manifest"), ("story-builder",)),
    Phase(8, "selected-timeline", "Selected timeline", ("candidate_rules", "repetition_filter", "repetition_reasons", "story_regressions", "budgeted_selection"), ("video-processing",)),
    Phase(9, "reel-builder", "Reel builder", ("reel_subscores", "segment_audits", "refined_windows", "reel_selection", "master_highlight"), ("selected-timeline",)),
    Phase(10, "documentary-builder", "Documentary builder", ("documentary_rows", "documentary_chronology", "documentary_contract"), ("selected-timeline", "story-builder")),
)
BY_COMMAND = {p.command: p for p in PHASES}


# every word by which a phase can be named
NAMED = {word: p for p in PHASES for word in (p.command, p.key, f"{p.number}", f"{p.number:02d}")}


def phase_help() -> str:
    """One line a phase: its number, its command, what it is called and what it writes."""
    wide = max(len(p.command) for p in PHASES)
    return "\n".join(f"{p.number:>2}  {p.command:<{wide}}  {p.title}: {', '.join(p.outputs)}" for p in PHASES)


def skip_tokens(values: Iterable[str]) -> set[str]:
    """The words of comma lists, in lower case."""
    return {token.strip().lower() for value in values for token in value.split(",") if token.strip()}


def is_skipped(phase: Phase, tokens: set[str]) -> bool:
    """Whether one of the words names this phase; words that name none are ignored."""
    return phase in map(NAMED.get, tokens)


def is_enabled(config: dict, phase: Phase) -> bool:
    return manifests.dotted(config, f"modules.{phase.key}.enabled", False) is True


def inventory(spark: SparkSession, config: dict) -> DataFrame | None:
    """The media files of the enabled media sets below media_root, or None without that setting."""
    root = manifests.dotted(config, "media_root")
    if not root:
        return None
    jobs = [j for j in media_sets.inventory_jobs(config, str(root).rstrip("/")) if scratch.path_exists(spark, j.folder)]
    found = [media.scan(spark, j.folder, j.media_set) for j in jobs]
    return reduce(DataFrame.unionByName, found) if found else None


def _state_of(spark: SparkSession, tables: str) -> list[tuple[str, int, int]]:
    """Name, bytes and time of the files of the tables, as the store says, without reading them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(tables)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    files, out = store.listFiles(folder, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprints(config: dict, state: list[tuple[str, int, int]]) -> dict[str, str]:
    """A digest of each phase: the rules' version, the tables' state, its own settings and media sets, and the digests of the phases it needs."""
    out: dict[str, str] = {}
    for phase in PHASES:
        own = [VERSION, state, phase.outputs, config.get(phase.key), manifests.dotted(config, f"modules.{phase.key}"), config.get("media_sets"), config.get("media_root"), [out[n] for n in phase.needs]]
        out[phase.command] = hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()
    return out


STAGES = "phase string, output string, fingerprint string, number long"


def stages_done(spark: SparkSession, out: str) -> dict[tuple[str, str], str]:
    """The fingerprint with which each output was last written: one row for each output there is."""
    path = f"{out}/_stages"
    if not scratch.path_exists(spark, path):
        return {}
    last = spark.read.schema(STAGES).json(path).groupBy("phase", "output").agg(F.max_by("fingerprint", "number").alias("fingerprint"))
    return {(r.phase, r.output): r.fingerprint for r in last.collect()}


def run(spark: SparkSession, tables: str, out: str, config: dict, *, only: Iterable[str] = (), skip: Iterable[str] = (), include_disabled: bool = False, execute: bool = False, resume: bool = False, write: Callable[[DataFrame, str], None] = manifests.write_manifest) -> list[tuple[str, str]]:
    """(command, what happened) of every phase in order: done, kept, planned (without execute nothing is run or written), skipped or disabled.

    A phase reads tables and writes one manifest for each of its outputs, each a stage; an unknown command is an error. Every stage is noted with its fingerprint
    when it is whole. With resume, stages of the same fingerprint are not run again, so a run that broke off goes on where it did, and a change of
    tables, settings or an earlier phase's settings redoes just what rests on it; kept is a phase of which no stage was run.
    """
    only = list(only)
    if unknown := sorted(set(only) - set(BY_COMMAND)):
        raise ValueError(f"unknown phases: {', '.join(unknown)}")
    tokens, done = skip_tokens(skip), []
    prints = fingerprints(config, _state_of(spark, tables)) if execute else {}
    known = stages_done(spark, out) if execute else {}
    number = last_number(spark, out) if execute else 0
    for phase in PHASES:
        if only and phase.command not in only:
            continue
        if is_skipped(phase, tokens):
            done.append((phase.command, "skipped"))
        elif not include_disabled and not is_enabled(config, phase):
            done.append((phase.command, "disabled"))
        elif not execute:
            done.append((phase.command, "planned"))
        else:
            stages = {name: (lambda name=name: QUERIES[name](spark, tables)) for name in phase.outputs}
            if phase.command == "inventory" and manifests.dotted(config, "media_root"):
                stages["media_inventory"] = lambda: inventory(spark, config)
            ran = False
            for name, stage in stages.items():
                path, mark = f"{out}/{phase.folder}/{name}", prints[phase.command]
                if resume and known.get((phase.command, name)) == mark and scratch.path_exists(spark, path):
                    continue
                if (frame := stage()) is None:
                    continue
                flat = [f"cast(`{f.name}` as string) as `{f.name}`" if f.dataType.typeName() in ("array", "struct", "map") else f"`{f.name}`" for f in frame.schema]
                write(frame.selectExpr(*flat), path)
                number, ran = number + 1, True
                spark.createDataFrame([(phase.command, name, mark, number)], STAGES).coalesce(1).write.mode("append").json(f"{out}/_stages")
            done.append((phase.command, "done" if ran else "kept"))
    return done


def last_number(spark: SparkSession, out: str) -> int:
    """The greatest number of a stage noted so far."""
    path = f"{out}/_stages"
    return (spark.read.schema(STAGES).json(path).agg(F.max("number")).first()[0] or 0) if scratch.path_exists(spark, path) else 0
