"""Command line: python -m hueframe COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.fitting import FitOptions
from .plans import extract as plans

VERSION = "0.1.0"


def _share(text: str) -> float:
    value = float(text)
    if not 0.0 <= value <= 1.0:
        raise argparse.ArgumentTypeError("a share is between 0 and 1")
    return value


def _fit_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--size", type=int, default=33)
    p.add_argument("--kernel", choices=["tetrahedral", "trilinear"], default="tetrahedral")
    p.add_argument("--smoothness", type=float, default=0.1)
    p.add_argument("--prior", type=float, default=0.01)
    p.add_argument("--prior-model", choices=["identity", "baseline_residual", "baseline_multigrid_residual"], default="identity")
    p.add_argument("--loss", choices=["huber", "l2"], default="huber")
    p.add_argument("--irls", type=int, default=3)
    p.add_argument("--connectivity", type=int, choices=[6, 18, 26], default=6)
    p.add_argument("--basis", choices=["rgb", "opponent"], default="rgb")
    p.add_argument("--bins", type=int, default=64)
    p.add_argument("--min-samples", type=int, default=3)
    p.add_argument("--weighting", choices=["coverage_fair", "frequency"], default="coverage_fair")
    p.add_argument("--transfer-fn", default="auto")
    p.add_argument("--shaper", choices=["auto", "on", "off"], default="auto")
    p.add_argument("--refine", type=int, default=0)
    p.add_argument("--huber-delta", type=float, default=1.0)
    p.add_argument("--chroma-ratio", type=float, default=4.0)
    p.add_argument("--shadow-auto", action="store_true", default=True, help="thresholds from the samples where they are dark (the default)")
    p.add_argument("--shadow-manual", dest="shadow_auto", action="store_false")
    p.add_argument("--shadow-threshold", type=_share, help="overrides the automatic one")
    p.add_argument("--deep-shadow-threshold", type=_share, help="overrides the automatic one")
    p.add_argument("--title", default="")


def _options(a: argparse.Namespace, **more) -> plans.Options:
    fit = FitOptions(size=a.size, kernel=a.kernel, smoothness=a.smoothness, prior=a.prior, prior_model=a.prior_model, loss=a.loss, rounds=a.irls, connectivity=a.connectivity, basis=a.basis, delta=a.huber_delta, chroma_ratio=a.chroma_ratio)
    return plans.Options(fit=fit, bins=a.bins, min_samples=a.min_samples, by_frequency=a.weighting == "frequency", transfer=a.transfer_fn, shaper={"auto": None, "on": True, "off": False}[a.shaper], refine_rounds=a.refine, title=a.title, auto_shadows=a.shadow_auto, shadow_threshold=a.shadow_threshold, deep_threshold=a.deep_shadow_threshold, **more)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("hueframe")
    parser.add_argument("--version", action="version", version=VERSION)
    parser.add_argument("--verbose", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("extract")
    for name in ("source", "target", "output"):
        p.add_argument(name)
    _fit_arguments(p)
    p = sub.add_parser("extract-batch")
    for name in ("manifest", "output"):
        p.add_argument(name)
    p.add_argument("--cluster", choices=["none", "manual", "fixed", "auto"], default="none")
    p.add_argument("--clusters", type=int, default=2)
    p.add_argument("--max-clusters", type=int, default=6)
    p.add_argument("--normalization", choices=["none", "luma_affine", "rgb_affine"], default="none")
    p.add_argument("--balance", choices=["equal", "by_bins", "by_pixels"], default="by_bins")
    p.add_argument("--outlier-sigma", type=float, default=0.0)
    p.add_argument("--min-pairs", type=int, default=3)
    p.add_argument("--allow-mixed-transfer", action="store_true")
    p.add_argument("--reports")
    _fit_arguments(p)
    p = sub.add_parser("route-shots")
    for name in ("shots", "centroids", "output"):
        p.add_argument(name)
    p.add_argument("--temporal-window", type=int, default=1)
    p.add_argument("--switch-penalty", type=float, default=0.0)
    p = sub.add_parser("hald-gen")
    p.add_argument("output")
    p.add_argument("--level", type=int, default=8)
    p.add_argument("--bits", type=int, choices=[8, 16], default=16)
    p = sub.add_parser("hald-recon")
    for name in ("processed", "output"):
        p.add_argument(name)
    p.add_argument("--level", type=int, default=8)
    p.add_argument("--size", type=int)
    p.add_argument("--title", default="")
    p = sub.add_parser("validate")
    for name in ("source", "target", "lut"):
        p.add_argument(name)
    p.add_argument("--kernel", choices=["tetrahedral", "trilinear"], default="tetrahedral")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("hueframe").getOrCreate()
    say = (lambda stage, share, text: print(f"{stage}: {text}", file=sys.stderr)) if a.verbose else None
    if a.command == "extract":
        r = plans.extract_pair(spark, a.source, a.target, a.output, _options(a), say)
        _show(r.metrics)
    elif a.command == "extract-batch":
        more = {"normalization": a.normalization, "balance": a.balance, "outlier_sigma": a.outlier_sigma, "min_pairs": a.min_pairs, "allow_mixed_transfers": a.allow_mixed_transfer}
        for label, r in plans.extract_batch(spark, a.manifest, a.output, _options(a, **more), a.cluster, a.clusters, a.max_clusters, a.reports, say).items():
            print(label, r.output)
            _show(r.metrics)
            print(plans.summary(r))
    elif a.command == "route-shots":
        plans.route_shots(spark, a.shots, a.centroids, a.output, a.temporal_window, a.switch_penalty).show(truncate=False)
    elif a.command == "hald-gen":
        print(plans.hald_generate(spark, a.output, a.level, a.bits))
    elif a.command == "hald-recon":
        print(plans.hald_reconstruct(spark, a.processed, a.output, a.level, a.size, a.title))
    else:
        _show(plans.validate(spark, a.source, a.target, a.lut, a.kernel))
    return 0


def _show(metrics) -> None:
    for r in metrics.collect():
        print(f"mean difference {r['mean_de2000']:.3f} ({plans.grade(r['mean_de2000'])}), 95 % {r['p95_de2000']:.3f}, largest {r['max_de2000']:.3f}; variation {r['total_variation']:.5f}, out of gamut {r['oog_pct']:.2f} %, coverage {r['coverage_pct']:.2f} %")


if __name__ == "__main__":
    raise SystemExit(main())
