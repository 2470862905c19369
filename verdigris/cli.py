"""python -m verdigris.cli build|query|smoke|evaluate|preprocess|extract ..."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdigris")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build", help="extract features of an image folder and store them")
    b.add_argument("image_dir")
    b.add_argument("out")
    b.add_argument("--norm", default="zscore", choices=("l2", "zscore", "minmax"))
    b.add_argument("--distance", default="cosine", choices=("cosine", "euclidean"))
    q = sub.add_parser("query", help="nearest images of one image")
    q.add_argument("out")
    q.add_argument("image")
    q.add_argument("--k", type=int, default=5)
    t = sub.add_parser("smoke", help="neighbours of a store's first record")
    t.add_argument("out")
    t.add_argument("--k", type=int, default=5)
    e = sub.add_parser("evaluate", help="retrieval quality of a store")
    e.add_argument("out")
    e.add_argument("--k", type=int, default=5)
    e.add_argument("--sample", type=int)
    e.add_argument("--no-dist", action="store_true")
    c = sub.add_parser("preprocess", help="clean an image folder")
    c.add_argument("folder")
    c.add_argument("out")
    c.add_argument("--method", default="rembg")
    c.add_argument("--denoise", default="nlmeans")
    x = sub.add_parser("extract", help="feature table of an image folder as JSON lines")
    x.add_argument("folder")
    x.add_argument("out")
    for s in sub.choices.values():
        s.add_argument("--master")
    a = p.parse_args(argv)

    from verdigris.operators import evaluate as E
    from verdigris.plans import jobs
    from verdigris.plans.extract import extract_folder
    from verdigris.session import build_session
    from verdigris.sources.images import save_results_json

    spark = build_session(master=a.master)
    if a.job == "build":
        jobs.build(spark, a.image_dir, a.out, a.norm, a.distance)[1].stats().show(truncate=False)
    elif a.job == "query":
        jobs.query(spark, a.out, a.image, a.k).show(truncate=False)
    elif a.job == "smoke":
        jobs.load(spark, a.out)[1].smoke(a.k).show(truncate=False)
    elif a.job == "evaluate":
        got = jobs.evaluate(jobs.load(spark, a.out)[1], a.k, a.sample, not a.no_dist)
        print(E.report(got["quality"], got["labels"], got["buckets"], got["distances"], a.k))
    elif a.job == "preprocess":
        jobs.preprocess_folder(spark, a.folder, a.out, method=a.method, denoiser=a.denoise).groupBy("is_valid").count().show()
    else:
        save_results_json(extract_folder(spark, a.folder), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
