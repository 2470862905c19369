"""Operators, kernels and jobs of the similarity library."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import paths as P
from verdigris.kernels import features as FE
from verdigris.kernels import image as K
from verdigris.kernels import preprocess as C
from verdigris.operators import evaluate as E
from verdigris.operators import knn, pixels
from verdigris.operators.normalize import Normalizer
from verdigris.operators.ordinal import with_ordinal
from verdigris.operators.store import VectorStore, modal_dimension
from verdigris.plans import jobs
from verdigris.plans.extract import extract, extract_folder, features_of
from verdigris.schema import FEATURE_NAMES, feature_names
from verdigris.sources.crawl import append_plan, class_table
from verdigris.sources.images import encode_png, scan_images

RNG = np.random.default_rng(42)
VEC = "o long, image_path string, label string, vector array<double>"


def vectors(spark, x, labels=None):
    rows = [(i, f"c{(labels[i] if labels else 'x')}/p{i:04d}.png", labels[i] if labels else None, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, VEC)


# --- names


def test_feature_names():
    assert len(FEATURE_NAMES) == 62 and FEATURE_NAMES[0] == "color_dom_b1" and FEATURE_NAMES[24] == "shape_area_ratio" and FEATURE_NAMES[-1] == "canopy_width_std"
    assert feature_names([]) == FEATURE_NAMES and len(feature_names(["texture"])) == 17
    with pytest.raises(ValueError):
        feature_names(["colour"])


# --- normalisation


@pytest.mark.parametrize("method", ["l2", "zscore", "minmax"])
def test_normalizer_against_numpy(spark, method, tmp_path):
    x = RNG.uniform(size=(100, 7)).astype(np.float32)
    x[:, 3] = 0.5
    df = vectors(spark, x)
    n = Normalizer(method).fit(df)
    got = np.array([r["vector"] for r in n.transform(df).orderBy("o").collect()])
    y = x.astype(float)
    want = {"l2": y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8), "zscore": (y - y.mean(0)) / (y.std(0) + 1e-8), "minmax": (y - y.min(0)) / (y.max(0) - y.min(0) + 1e-8)}[method]
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(n.transform_one(x[0]), want[0], atol=1e-5)
    n.save(spark, str(tmp_path / "n"))
    again = Normalizer.load(spark, str(tmp_path / "n"))
    assert again == n and again.info(spark).first()["n_samples_fitted"] == 100


def test_normalizer_contract(spark):
    with pytest.raises(ValueError):
        Normalizer("max")
    df = vectors(spark, [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(RuntimeError):
        Normalizer("zscore").transform(df)
    n = Normalizer("zscore").fit(df)
    with pytest.raises(ValueError):
        n.transform_one([1, 2, 3])
    with pytest.raises(Exception, match="expected 2 dimensions"):
        n.transform(vectors(spark, [[1.0, 2.0, 3.0]])).collect()
    with pytest.raises(ValueError):
        Normalizer("l2").fit(df.union(vectors(spark, [[1.0]])))
    assert Normalizer("l2").transform(vectors(spark, [[0.0, 0.0]])).first()["vector"] == [0, 0]
    clipped = n.transform(vectors(spark, [[1e6, -1e6]]), clip=3.0).first()["vector"]
    assert clipped == [3, -3]


# --- neighbours and store


def test_batch_top_k_brute_force(spark):
    x = RNG.normal(size=(60, 5)).astype(np.float32)
    x[10] = x[11] = x[12]
    df = vectors(spark, x).withColumn("record_idx", F.col("o")).repartition(5)
    got = {}
    for r in knn.batch_top_k(df, df, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"], r["distance"]))
    y = x.astype(float)
    for q in range(60):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(60))[:4]
        have = sorted(got[q])
        assert [h[1] for h in have] == [w[1] for w in want] and np.allclose([h[2] for h in have], [w[0] for w in want])
    assert knn.batch_top_k(df, df.limit(0), 4).count() == 0
    assert knn.batch_top_k(df.limit(3), df.limit(1), 10).count() == 3
    with pytest.raises(ValueError):
        knn.batch_top_k(df, df, 0)


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    df = vectors(spark, RNG.normal(size=(40, 3))).withColumn("record_idx", F.col("o"))
    got = knn.batch_top_k(df, df, 1).collect()
    assert sorted((r["qid"], r["rid"]) for r in got) == [(i, i) for i in range(40)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_store_round_trip(spark, metric, tmp_path):
    x = RNG.uniform(size=(50, 6))
    s = VectorStore(spark, metric).insert_batch(vectors(spark, x, [str(i % 3) if i % 4 else "" for i in range(50)]), "o")
    with pytest.raises(RuntimeError):
        s.query(x[0])
    s.build()
    hit = s.query(x[7], 3).collect()
    assert hit[0]["record_idx"] == 7 and hit[0]["distance"] < 1e-6 and [h["rank"] for h in hit] == [1, 2, 3]
    assert s.query(x[0], 99).count() == 50
    with pytest.raises(ValueError):
        s.query([1.0])
    path = hit[0]["image_path"]
    around = s.query_by_path(path, 3).collect()
    assert path not in [r["image_path"] for r in around] and [r["rank"] for r in around] == [2, 3, 4]
    with pytest.raises(ValueError):
        s.query_by_path("none")
    shown = s.search_like_page(x[7], path).collect()
    assert [r["rank"] for r in shown] == [1, 2, 3, 4, 5]
    st = s.stats().first()
    assert (st["n_records"], st["n_labels"], st["labels"], st["tree_built"], st["n_features"]) == (50, 3, ["0", "1", "2"], True, 6)
    assert s.save(str(tmp_path / "s"))
    again = VectorStore.load(spark, str(tmp_path / "s"))
    assert again.built and again.query(x[7], 3).first()["record_idx"] == 7 and again.records.filter("label is null").count() == 13
    assert s.insert("new.png", x[0], "z", source="web") == 50 and not s.built
    assert s.records.filter("record_idx = 50").first()["meta"] == {"source": "web"}


def test_store_contract(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorStore(spark, "manhattan")
    s = VectorStore(spark)
    assert not s.build().built and not s.save(str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        VectorStore.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        s.insert_lists(["a"], [])
    s.insert_lists(["a", "b"], [[1.0, 2.0], [3.0, 4.0]], ["x", None])
    with pytest.raises(ValueError):
        s.insert("c", [1.0])
    with pytest.raises(ValueError):
        s.build().query([1.0, 2.0], 0)
    tied = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>")
    assert modal_dimension(tied).first()["vector"] == [1.0]


def test_ordinals(spark):
    df = spark.range(1000).repartition(7)
    got = with_ordinal(df, "id", start=5).collect()
    assert all(r["record_idx"] == r["id"] + 5 for r in got)
    assert with_ordinal(df.limit(0), "id").count() == 0
    wide = spark.range(200_000).repartition(13).withColumn("v", F.array_repeat(F.col("id").cast("double"), 64)).withColumn("half", F.col("id") % 2)
    got = with_ordinal(wide, "half", "id", range_rows=20_000).select("id", "half", "record_idx").agg(F.count("record_idx").alias("n"), F.max(F.abs(F.col("record_idx") - F.expr("half * 100000 + id div 2"))).alias("off")).first()
    assert (got["n"], got["off"]) == (200_000, 0)


# --- evaluation


def brute_eval(x, labels, k):
    y = x.astype(np.float32).astype(float)
    ap, p1, pk, rk = [], 0, [], []
    for q in range(len(y)):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        order = [i for i in sorted(range(len(y)), key=lambda i: (d[i], i))[: k + 1] if d[i] > 1e-9][:k]
        if not order:
            continue
        hit = [labels[i] == labels[q] for i in order]
        ap.append(sum((sum(hit[: i + 1]) / (i + 1)) for i in range(len(hit)) if hit[i]) / sum(hit) if any(hit) else 0.0)
        p1 += hit[0]
        pk.append(sum(hit) / k)
        rk.append(sum(hit) / max(1, min(labels.count(labels[q]) - 1, k)))
    return np.mean(ap), p1 / len(y), np.mean(pk), np.mean(rk)


def test_evaluation_brute_force(spark):
    labels = [str(i % 4) for i in range(80)]
    x = RNG.normal(size=(80, 3)) + np.array([[int(v), 0, 0] for v in labels])
    x[5] = x[9]
    s = VectorStore(spark).insert_batch(vectors(spark, x, labels), "o").build()
    got = jobs.evaluate(s, 5)
    q = got["quality"].first()
    assert np.allclose((q["map"], q["p_at_1"], q["p_at_k"], q["recall_at_k"]), brute_eval(x, [f"c{v}" for v in labels], 5)) and q["n_queries"] == 80
    d = got["distances"].first()
    assert d["n_intra"] + d["n_inter"] == 80 * 79 // 2
    text = E.report(got["quality"], got["labels"], got["buckets"], got["distances"])
    assert "mAP@5" in text and "Fisher" in text
    part = jobs.evaluate(s, 5, sample=10, distances=False)
    assert part["quality"].first()["n_queries"] == 10 and part["distances"].first()["n_intra"] == 1
    assert E.ap_buckets(got["queries"].limit(0)).first()["low"] is None


def test_diagnosis(spark):
    q = spark.createDataFrame([(0.7,)], "map double")
    d = spark.createDataFrame([(0.5, 1.6, 31.0)], "fisher double, mean_intra double, overlap_pct double")
    r = E.diagnosis(q, d).first()
    assert (r["verdict"], r["stars"], len(r["notes"])) == ("good", 2, 3)


# --- paths and crawl lists


def test_labels(spark):
    rows = ["tree/A b/x.png", "res/A b_A b_tree_1 (8).png", "x.png", "batch/foo_1.jpg", "a/b/c.JPG", "Acer_x_tree_2.png"]
    df = spark.createDataFrame([(r,) for r in rows], "path string")
    got = [tuple(r) for r in df.select(P.build_label(F.col("path")), P.eval_label(F.col("path"), F.lit("s")), P.suffix(F.col("path"))).collect()]
    assert got == [("A b", "A b", "png"), ("A b", "A b", "png"), (None, "s", "png"), ("foo", "s", "jpg"), ("b", "b", "jpg"), ("Acer", "Acer", "png")]


def test_resolve_and_crawl(spark):
    paths = spark.createDataFrame([("tree/a/x.png",), ("/abs/y.png",), ("gone.png",)], "path string")
    files = spark.createDataFrame([("/res/a/x.jpeg",), ("/res/a/x.png",), ("/abs/y.png",)], "file string")
    assert {r["path"]: r["resolved"] for r in P.resolve(paths, files, ("/app", "/res")).collect()} == {"tree/a/x.png": "/res/a/x.jpeg", "/abs/y.png": "/abs/y.png", "gone.png": None}
    classes = class_table(spark, {"Acer": "acer tree", "Betula": "birch"})
    plan = append_plan(classes, spark.createDataFrame([("r/Acer/1.jpg",), ("r/Acer/2.txt",)], "path string"))
    assert {r["class_dir"]: r["file_idx_offset"] for r in plan.collect()} == {"Acer": 2, "Betula": 0}


# --- kernels


def disc(n=128, r=40):
    y, x = np.mgrid[0:n, 0:n]
    return (((x - n // 2) ** 2 + (y - n // 2) ** 2) <= r * r).astype(np.uint8) * 255


def test_contours_of_known_forms():
    box = np.zeros((100, 100), np.uint8)
    box[20:61, 30:51] = 255
    c = K.contours(box)[0]
    assert K.area(c) == 800 and K.perimeter(c) == 120 and K.area(K.hull(c)) == 800
    assert np.allclose(K.hu_moments(c)[:2], [0.5 / 2.4, 0.125**2])
    c = K.contours(disc())[0]
    assert abs(K.area(c) - np.pi * 40**2) < 0.03 * np.pi * 40**2 and abs(K.perimeter(c) / (2 * np.pi * 40) - 1.05) < 0.05
    one = np.zeros((5, 5), np.uint8)
    one[2, 2] = 255
    assert len(K.contours(one)[0]) == 1 and K.contours(np.zeros((4, 4), np.uint8)) == []


def test_components_by_flood():
    for seed in range(5):
        on = np.random.default_rng(seed).random((30, 30)) < 0.45
        for diagonal in (True, False):
            label, size = K.components(on, diagonal)
            seen, want = np.zeros_like(on), []
            for r, c in zip(*np.nonzero(on), strict=True):
                if not seen[r, c]:
                    stack, n = [(r, c)], 0
                    seen[r, c] = True
                    while stack:
                        a, b = stack.pop()
                        n += 1
                        for da in (-1, 0, 1):
                            for db in (-1, 0, 1):
                                if (diagonal or da * db == 0) and 0 <= a + da < 30 and 0 <= b + db < 30 and on[a + da, b + db] and not seen[a + da, b + db]:
                                    seen[a + da, b + db] = True
                                    stack.append((a + da, b + db))
                    want.append(n)
            assert sorted(size.tolist()) == sorted(want) and (label > 0).sum() == on.sum()


def test_otsu_morphology_resize():
    x = np.concatenate([np.full(50, 40), np.full(50, 200)]).astype(np.uint8).reshape(10, 10)
    assert 40 <= K.otsu(x) < 200
    m = disc(60, 15)
    assert (K.opening(K.closing(m, 7), 7) > 0).sum() > 0.95 * (m > 0).sum()
    assert (K.dilate(m, K.ellipse(7)) >= m).all() and (K.erode(m, K.ellipse(7)) <= m).all()
    flat = np.full((30, 40, 3), 77, np.uint8)
    assert (K.resize(flat, 13, 9) == 77).all() and (K.resize(flat, 80, 90) == 77).all()
    assert (K.from_lab(K.to_lab(np.array([[[10, 200, 30]]], np.uint8))) == [[[10, 200, 30]]]).all()
    assert K.canny(np.full((20, 20), 9, np.uint8), 50, 150).max() == 0
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 255
    assert 15 <= (K.canny(step, 50, 150) > 0).sum() <= 40


def test_features_and_group_errors():
    img = np.full((256, 256, 3), 230, np.uint8)
    m = disc(256, 80) > 0
    img[m] = np.stack([RNG.integers(20, 60, m.sum()), RNG.integers(120, 200, m.sum()), RNG.integers(20, 60, m.sum())], 1)
    feats, errors = features_of(img, None)
    assert sorted(feats) == sorted(FEATURE_NAMES) and not errors and all(np.isfinite(list(feats.values())))
    assert feats["shape_symmetry"] > 0.95 and feats["canopy_n_components"] == 1 and abs(feats["shape_centroid_x_norm"] - 0.5) < 0.01
    assert abs(sum(feats[f"texture_lbp_{i}"] for i in range(10)) - 1) < 1e-9

    def broken(rgb, mask):
        raise RuntimeError("no")

    feats, errors = features_of(img, None, extractors={"shape": broken})
    assert len(feats) == 50 and list(errors) == ["shape"]
    blank, _ = features_of(np.zeros((64, 64, 3), np.uint8), np.zeros((64, 64), np.uint8))
    assert blank["shape_crown_ratio"] == 0.5 and blank["color_v_mean"] == 0


def test_kernels_agree_with_measures(spark):
    """LBP, GLCM, gradient, roughness, profile and symmetry: pixel tables against numpy."""
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    px = pixels.raster(emb).cache()
    image = {}
    for r in px.filter("img < 5").collect():
        image.setdefault(r["img"], np.zeros((8, 8, 4), np.int64))[r["r"], r["c"]] = (r["rr"], r["g"], r["b"], 255 * r["fg"])
    got = {n: {r["img"]: r for r in pixels.measure(px, n).filter("img < 5").collect()} for n in ("px_glcm_stats", "px_gradient_stats", "px_roughness", "px_vertical_profile", "px_symmetry", "px_hsv_stats", "px_centroid")}
    for i, x in image.items():
        rgb, mask = x[..., :3].astype(np.uint8), x[..., 3].astype(np.uint8)
        t, c, col = FE.texture(rgb, mask), FE.canopy(rgb, mask), FE.color(rgb, mask)
        g = got["px_glcm_stats"][i]
        assert np.allclose([g[k] for k in ("contrast", "homogeneity", "energy", "correlation")], [t[k] for k in ("contrast", "homogeneity", "energy", "correlation")], atol=1e-4)
        assert np.allclose(got["px_gradient_stats"][i]["grad_mean"], t["grad_mean"], atol=1e-4) and np.allclose(got["px_roughness"][i]["roughness"], t["roughness"], atol=1e-4)
        assert np.allclose(got["px_vertical_profile"][i]["peak_row"], c["peak_row_norm"], atol=1e-6) and np.allclose(got["px_symmetry"][i]["symmetry"], FE.symmetry(mask), atol=1e-6)
        assert np.allclose([got["px_hsv_stats"][i][k] for k in ("h_mean", "h_std", "s_mean", "v_std")], [col[k] for k in ("h_mean", "h_std", "s_mean", "v_std")], atol=2e-4)


def test_preprocess_steps():
    img = np.full((120, 100, 3), 240, np.uint8)
    img[30:90, 30:70] = [40, 150, 40]
    img = np.clip(img.astype(int) + RNG.integers(-12, 12, img.shape), 0, 255).astype(np.uint8)
    assert C.validate(img) and not C.validate(np.zeros((10, 10, 3), np.uint8)) and not C.validate(np.full((80, 80, 3), 128, np.uint8))
    assert C.letterbox(img, (64, 64)).shape == (64, 64, 3)
    for method in ("none", "gaussian", "bilateral", "nlmeans"):
        assert C.denoise(img[:40, :40], method).shape == (40, 40, 3)
    with pytest.raises(ValueError):
        C.denoise(img, "median")
    with pytest.raises(ValueError):
        C.segment(img, "unet")
    mask, out = C.segment(img)
    assert mask[60, 50] == 255 and mask[5, 5] == 0 and (out[5, 5] == 255).all()
    cut, cm, box = C.crop(img, mask)
    assert cut.shape[:2] == cm.shape == (box[3], box[2]) and cm.any()
    assert C.crop(img, mask * 0)[2] == (0, 0, 100, 120)
    x, m = C.centre(cut, cm, (64, 64))
    assert x.shape == (64, 64, 3) and m.any()
    a, am = C.augment(x, m, seed=3)
    b, _ = C.augment(x, m, seed=3)
    assert (a == b).all() and am.shape == m.shape
    same, _ = C.augment(x, None, flip_h=False, rotate=(0, 0), brightness=(1, 1))
    assert (same == x).all()
    assert C.orient(img, 6).shape == (100, 120, 3) and (C.orient(img, 6, "reference") == np.rot90(img)).all() and C.orient(img, 9).shape == img.shape
    exif = b"\xff\xd8\xff\xe1\x00\x22Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    assert C.exif_orientation(exif) == 6 and C.exif_orientation(b"PNG") == 1


# --- jobs


@pytest.fixture(scope="module")
def image_folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = np.random.default_rng(0)
    for c, colour in enumerate(([40, 160, 40], [60, 120, 20])):
        for i in range(3):
            img = np.full((96, 96, 3), 235, np.uint8)
            m = disc(96, 20 + 8 * c + i) > 0
            img[m] = np.clip(np.array(colour) + rng.integers(-30, 30, (m.sum(), 3)), 0, 255)
            p = Path(root, f"class {c}", f"t{i}.PNG" if i == 0 else f"t{i}.png")
            p.parent.mkdir(exist_ok=True)
            p.write_bytes(encode_png(img))
    Path(root, "class 0", "broken.png").write_bytes(b"not an image")
    Path(root, "class 0", "note.txt").write_text("x")
    return str(root)


def test_scan_build_query_evaluate(spark, image_folder, tmp_path):
    assert scan_images(spark, image_folder).count() == 7
    with pytest.raises(ValueError):
        scan_images(spark, str(tmp_path / "none"))
    assert scan_images(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    norm, store = jobs.build(spark, image_folder, str(tmp_path / "out"))
    assert len(store) == 6 and store.n_features == 62 and store.distance == "cosine" and {r["label"] for r in store.records.collect()} == {"class 0", "class 1"}
    hits = jobs.query(spark, str(tmp_path / "out"), f"{image_folder}/class 1/t1.png", 3).collect()
    assert hits[0]["image_path"].endswith("class 1/t1.png") and hits[0]["label"] == "class 1"
    assert jobs.evaluate(store, 2)["quality"].first()["map"] > 0.5
    rows = extract_folder(spark, image_folder, groups=["shape"], size=(64, 64)).collect()
    bad = [r for r in rows if not r["success"]]
    assert len(bad) == 1 and "general" in bad[0]["errors"] and rows[0]["n_features"] in (0, 12)
    normalised = extract(scan_images(spark, image_folder), normalizer=norm).filter("success").first()
    assert max(abs(v) for v in normalised["vector_normalized"]) <= 3


def test_load_image_and_placeholder(spark, image_folder):
    from verdigris.sources.images import load_image, placeholder

    assert load_image(spark, f"{image_folder}/class 1/t1.png").shape == (96, 96, 3)
    with pytest.raises(FileNotFoundError):
        load_image(spark, f"{image_folder}/class 1/gone.png")
    with pytest.raises(ValueError):
        load_image(spark, f"{image_folder}/class 0/broken.png")
    assert placeholder().shape == (300, 400, 3) and (placeholder()[0, 0] == (45, 45, 60)).all()


def test_preprocess_folder(spark, image_folder, tmp_path):
    got = jobs.preprocess_folder(spark, image_folder, str(tmp_path / "p"), size=(64, 64), denoiser="gaussian").collect()
    assert len(got) == 7 and sum(r["is_valid"] for r in got) >= 1
    assert {p.name for p in Path(tmp_path, "p", "masks").rglob("*.png")} == {p.name for p in Path(tmp_path, "p", "images").rglob("*.png")}
    assert [r["metadata"]["error"] for r in got if r["image_path"].endswith("broken.png")] == ["decode"]


def test_stream_append(spark, tmp_path):
    from verdigris.streaming.append import append_stream, read_appended

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for k in range(2):
        spark.createDataFrame([(f"b{k}/{i}.png", "" if i else "x", [float(i + 1), 2.0]) for i in range(3)], "image_path string, label string, vector array<float>").coalesce(1).write.mode("append").parquet(src)
        append_stream(spark, src, out, cp).awaitTermination(120)
    got = read_appended(spark, out).orderBy("record_idx").collect()
    assert [r["record_idx"] for r in got] == list(range(6)) and got[0]["image_path"].startswith("b0") and got[1]["label"] is None
    assert abs(np.linalg.norm(got[0]["vector"]) - 1) < 1e-6


# --- registered queries


def test_registered_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    from verdigris import catalog

    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in ("knn_euclidean", "knn_cosine", "knn_batch_topk", "map_at_k", "diagnosis_rules", "transform_zscore", "label_from_path_eval", "px_glcm_stats", "px_otsu_threshold", "store_stats", "connected_components", "stream_append", "null_label_roundtrip", "feature_groups_raster"):
        df = entry.queries()[name](spark, sf)
        cur = con.execute(catalog.SQL[name])
        cols = [c[0] for c in cur.description]
        want = sorted((tuple(fix(v) for v in r) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(fix(r[c]) for c in cols) for r in df.collect()), key=repr) == want, name
    assert entry.entry(spark).count() == 5
    assert json.dumps(sorted(entry.oracle_sql()))


def test_sql_functions_and_path_labels(spark):
    from verdigris.functions.sql import register

    register(spark)
    r = spark.sql("select l2_norm(array(3D, 4D)) as n, l2_distance(array(0D, 1D), array(3D, 5D)) as d, dot_product(array(1D, 2D), array(3D, 4D)) as p, l2_normalize(array(3D, 4D)) as u").first()
    assert (r["n"], r["d"], r["p"]) == (5, 5, 11) and abs(r["u"][0] - 0.6) < 1e-6
    records = spark.createDataFrame([(0, "x.png", "s"), (1, "x.png", "t")], "record_idx long, image_path string, label string")
    paths = spark.createDataFrame([("x.png",), ("a/y.png",)], "path string")
    assert {r["path"]: r["label"] for r in P.labels_of_paths(paths, records).collect()} == {"x.png": "s", "a/y.png": "a"}
    box = C.draw_box(np.zeros((20, 20, 3), np.uint8), (5, 5, 10, 10))
    assert box[5, 5, 0] == 255 and box[10, 10, 0] == 0
    assert "valid" in C.Result(False, C.Validation(False, "x")).summary()


def test_label_of_path_has_a_row_for_every_page(spark, tmp_path):
    """Against its SQL, on pages that repeat a url, share a generic parent, or have no url or id."""
    import duckdb

    from verdigris import catalog

    urls = [(3, "http://x.org/res/a"), (18, "http://x.org/res/a"), (8, "http://x.org/res/a"), (5, "https://y.org/de/b"), (20, "https://y.org/de/b"), (9, "a_b_tree_1/res/c"), (9, "a_b_tree_1/res/c"), (12, None), (7, None), (None, "res/d")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(((r["path"], r["label"]) for r in catalog.Q["label_of_path"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(catalog.SQL["label_of_path"]).fetchall(), key=repr) and len(got) == 15
    records = spark.createDataFrame([(0, "x.png", "s"), (1, "x.png", "t")], "record_idx long, image_path string, label string")
    paths = spark.createDataFrame([("x.png",), ("x.png",)], "path string")
    assert [r["label"] for r in P.labels_of_paths(paths, records).collect()] == ["s", "s"]
