"""``python -m tesserae detect FOLDER``: detections in a folder of anymaps; ``--help`` lists the switches."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="tesserae")
    args.add_argument("command", choices=["detect"])
    args.add_argument("folder")
    args.add_argument("--family", action="append", metavar="NAME[:ERRORS]", help="a family and how many bits are corrected; may be given several times")
    args.add_argument("--errors", type=int, default=2, help="corrected bits of families that don't state theirs")
    args.add_argument("--decimate", type=float, default=1.0)
    args.add_argument("--sigma", type=float, default=0.0, help="blur, or sharpening below 0")
    args.add_argument("--sharpening", type=float, default=0.25)
    args.add_argument("--no-refine", action="store_true")
    args.add_argument("--deglitch", action="store_true")
    args.add_argument("--full-blur", action="store_true")
    args.add_argument("--least-margin", type=float, default=0.0)
    args.add_argument("--out", help="write detections as Parquet to this folder instead of showing them")
    args.add_argument("--debug", help="write the image after each step as Parquet to this folder")
    return args


def detector(a: argparse.Namespace):
    """The detector that the switches describe."""
    from tesserae.config import DetectorConfig, QuadParams
    from tesserae.detector import DetectorBuilder

    qtp = QuadParams(deglitch=a.deglitch, full_blur=a.full_blur)
    builder = DetectorBuilder(DetectorConfig(quad_decimate=a.decimate, quad_sigma=a.sigma, refine_edges=not a.no_refine, decode_sharpening=a.sharpening, qtp=qtp))
    for name in a.family or ["tag25h9"]:
        name, _, errors = name.partition(":")
        builder.add_family(name, int(errors or a.errors))
    return builder.build()


def main() -> None:
    a = parser().parse_args()
    from pyspark.sql import SparkSession

    from tesserae.operators import reconcile
    from tesserae.sources import pnm

    spark, found = SparkSession.builder.getOrCreate(), detector(a)
    frames = pnm.read_frames(spark, a.folder)
    if a.debug:
        found.debug(frames).write.mode("overwrite").parquet(a.debug)
    rows = reconcile.with_margin(found.detect(frames), a.least_margin)
    if a.out:
        rows.write.mode("overwrite").parquet(a.out)
    else:
        rows.select("image_id", "family", "id", "hamming", "margin", "center").orderBy("image_id", "id").show(truncate=False)


if __name__ == "__main__":
    main()
