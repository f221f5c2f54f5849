"""Command line: python -m strandmill.cli sample|compress|decompress|combo ..., over Parquet tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.plans import combo, compressor, config, progress, report, sampler
from strandmill.session import ship_package

RETENTION = {"min_retention": "min_retention_ratio", "max_retention": "max_retention_ratio", "target_retention": "soft_target_retention"}


def output_dir(base: str, run: str, cfg: dict) -> str:
    """Where a run writes: the given folder, else the configured one, with the run's name below it."""
    return f"{(base or cfg['paths']['output_dir']).rstrip('/')}/{run}"


def settings(args: argparse.Namespace) -> dict:
    """Defaults, then the file, then the policy, then presets, then single options."""
    cfg = config.load(args.config) if args.config else config.config()
    if args.policy == "adaptive":
        cfg = config.merge(cfg, config.PRESETS["adaptive_v4"])
        given = {key: getattr(args, name) for name, key in RETENTION.items() if getattr(args, name) is not None}
        cfg = config.merge(cfg, {"adaptive": given})
    elif args.policy == "fixed":
        cfg = config.merge(config.merge(cfg, config.PRESETS["adaptive_v4"]), {"scoring": {"retention_mode": "target_ratio", "target_retention_ratio": args.retention}})
    for name in args.preset:
        for layer in (*config.BASES.get(name, ()), name):
            cfg = config.merge(cfg, config.PRESETS[layer])
    return cfg


def sample(spark: SparkSession, args: argparse.Namespace) -> str:
    """Scores, the kept set, manifests and a one-row report a video."""
    cfg = settings(args)
    frames, features, motion = (spark.read.parquet(p) for p in (args.frames, args.features, args.motion))
    out, where = sampler.run(frames, features, motion, cfg), output_dir(args.out, args.name, cfg)
    out.scores.write.parquet(f"{where}/scores")
    out.selection.write.parquet(f"{where}/selection")
    kept: DataFrame = spark.read.parquet(f"{where}/selection")
    totals = spark.read.parquet(f"{where}/scores").groupBy("video_id").agg(F.count("*").alias("n"))
    report.write_json(report.manifest(kept, totals, cfg["scoring"]["retention_mode"]), f"{where}/manifest")
    report.write_json(totals.join(out.richness.drop("n"), "video_id").join(kept.groupBy("video_id").agg(F.count("*").alias("n_kept"), F.max("tau").alias("tau")), "video_id", "left"), f"{where}/report")
    return where


def compress(spark: SparkSession, args: argparse.Namespace) -> str:
    cfg = config.load(args.config, config.COMPRESS) if args.config else config.COMPRESS
    where = output_dir(args.out, args.name, cfg)
    raw = spark.read.parquet(args.raw) if args.raw else None
    compressor.compress(spark.read.parquet(args.frames), cfg, raw=raw).withColumn("interval", F.lit(cfg["soft_edge"]["keyframe_interval"])).write.parquet(f"{where}/packets")
    return where


def decompress(spark: SparkSession, args: argparse.Namespace) -> str:
    where = output_dir(args.out, args.name, config.COMPRESS)
    packets = spark.read.parquet(args.packets)
    interval = packets.select("interval").first()
    compressor.decompress(packets, interval[0] if interval else 1).write.parquet(f"{where}/labels")
    return where


def run_combo(spark: SparkSession, args: argparse.Namespace) -> str:
    """Sampling and coding in one run: what ``sample`` writes, then packets, decoded labels and a report of sizes for the kept frames."""
    cfg = config.load(args.codec_config, config.COMPRESS) if args.codec_config else config.COMPRESS
    told = progress.Progress([*progress.steps(settings(args)), "Code what is kept", "Decode and report"])
    told.begin()
    where = sample(spark, args)
    told.done()
    told.begin("Code what is kept")
    out = combo.run_combo(spark.read.parquet(args.labels), spark.read.parquet(f"{where}/selection"), cfg, args.frame_bytes)
    out.packets.withColumn("interval", F.lit(cfg["soft_edge"]["keyframe_interval"])).write.parquet(f"{where}/packets")
    told.done()
    told.begin("Decode and report")
    out.decoded.write.parquet(f"{where}/labels")
    report.write_json(out.report, f"{where}/sizes")
    told.done()
    return where


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, run, inputs in (
        ("sample", sample, ("frames", "features", "motion")), ("compress", compress, ("frames",)), ("decompress", decompress, ("packets",)), ("combo", run_combo, ("frames", "features", "motion", "labels")),
    ):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for i in inputs:
            c.add_argument(f"--{i}", required=True)
        c.add_argument("--out", default="")
        c.add_argument("--name", default=name)
        c.add_argument("--config")
        if name == "compress":
            c.add_argument("--raw", help="raw pictures, for key pictures")
        if name == "combo":
            c.add_argument("--codec-config")
            c.add_argument("--frame-bytes", type=int, default=1280 * 720 * 3)
        if name in ("sample", "combo"):
            c.add_argument("--policy", choices=("default", "adaptive", "fixed"), default="default")
            c.add_argument("--preset", action="append", default=[], choices=sorted(config.PRESETS))
            c.add_argument("--retention", type=float, default=0.2)
            for option in RETENTION:
                c.add_argument("--" + option.replace("_", "-"), type=float)
    return p


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship_package(spark)
    where = args.run(spark, args)
    print(json.dumps({"output": where}))
    return where


if __name__ == "__main__":
    main()
