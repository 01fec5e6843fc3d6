"""Kernels, sources, detection and numeric functions; and queries against their SQL."""

import itertools
import math

import numpy as np
import pytest

from tesserae import __main__ as main
from tesserae import families
from tesserae.config import Camera, ConfigError, DetectorConfig, FamilyError, QuadParams, gaussian_kernel, load_config
from tesserae.detector import DetectorBuilder, _Reader, detect_one, detect_stack
from tesserae.functions import algebra, geometry
from tesserae.operators import analytics, decode, frames, kernels, pixels, pose, reconcile
from tesserae.sources import generators, pnm, records, scenes
from tesserae.streaming import frames as stream

WORDS36 = [51559569327, 10220429184, 10179510348, 57948543051]


def as_image(df, key=0):
    rows = [r for r in df.collect() if r["image_id"] == key]
    im = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.int64)
    for r in rows:
        im[r["y"], r["x"]] = r["v"]
    return im


# Families and words.


def test_rotations():
    assert families.rotations(WORDS36[0], 36) == WORDS36
    for fam in (families.family(n) for n in ("tag16h5", "tag25h9", "tagCircle21h7")):
        for code in fam.codes:
            assert families.rotate90(families.rotations(code, len(fam.bits))[3], len(fam.bits)) == code
        assert families.min_distance(fam) == fam.min_hamming


def test_every_correctable_word_is_found():
    fam = families.family("tag25h9")
    read = _Reader(fam, 3)
    masks = [sum(1 << b for b in bits) for k in range(4) for bits in itertools.combinations(range(25), k)]
    for id_, code in list(enumerate(fam.codes))[:3]:
        for m in masks:
            assert read(code ^ m) == (id_, m.bit_count(), 0)
    assert _Reader(fam, 0)(fam.codes[0] ^ 1) is None and _Reader(fam, 3)(fam.codes[0] ^ 0b11111) is None
    for turn in range(4):
        assert read(families.rotations(fam.codes[5], 25)[turn]) == (5, 0, (4 - turn) % 4)


def test_lookup_in_spark_is_the_reader(spark):
    fam = families.family("tag25h9")
    rng = np.random.default_rng(1)
    words = [int(w) for w in rng.integers(0, 1 << 25, 300)] + [c ^ 0b101 for c in fam.codes] + [families.rotate90(c, 25) ^ 4096 for c in fam.codes]
    df = spark.createDataFrame(list(enumerate(words)), "k bigint, word bigint")
    got = {r["k"]: (r["id"], r["hamming"], r["rotation"]) for r in decode.lookup(df, fam, key="k", errors=2).collect()}
    read = _Reader(fam, 2)
    want = {k: hit for k, w in enumerate(words) if (hit := read(w))}
    assert got == want


def test_families_without_codes(tmp_path):
    with pytest.raises(FamilyError):
        DetectorBuilder().add_family("tagCustom48h12")
    with pytest.raises(FamilyError):
        families.family("nothing")
    with pytest.raises(ConfigError):
        DetectorBuilder().build()
    path = tmp_path / "codes.txt"
    path.write_text("d7e00984b\n0x2\n")
    assert families.load_family("tag36h11", str(path)).codes == (0xD7E00984B, 2)
    assert families.custom_family("x", [1, 2], families.family("tag16h5")).name == "tag16h5 (modified)"


def test_geometry_and_codes_of_large_families(spark):
    for name, bits, codes in (("tag36h10", 36, 2320), ("tag36h11", 36, 587), ("tagStandard41h12", 41, 2115), ("tagCircle49h12", 49, 0), ("tagCustom48h12", 48, 0), ("tagStandard52h13", 52, 0)):
        fam = families.family(name)
        assert len(fam.bits) == len(set(fam.bits)) == bits and len(set(fam.codes or ())) == codes
        ring = (fam.total_width - fam.width_at_border) // 2
        assert fam.geometric == all(0 <= v + ring < fam.total_width for at in fam.bits for v in at)
    assert families.min_distance(families.family("tag36h11")) == 11
    with pytest.raises(FamilyError):
        DetectorBuilder().add_family("tagStandard41h12")
    rng = np.random.default_rng(3)
    for name in ("tag36h11", "tagCircle49h12", "tagCustom48h12", "tagStandard52h13"):
        fam = families.family(name)
        if fam.codes is None:
            fam = families.custom_family("", [int(c) for c in rng.integers(0, 1 << len(fam.bits), 20)], fam)
        for turn in range(4):
            (d,) = detect_one(scene(fam, 7 + turn, turn, 7), DetectorConfig(), [_Reader(fam, 1)])
            assert (d["id"], d["hamming"]) == (7 + turn, 0)
        words = [families.rotations(c, len(fam.bits))[i % 4] ^ (1 << i % 30) for i, c in enumerate(fam.codes)]
        got = {r["k"]: (r["id"], r["hamming"]) for r in decode.lookup(spark.createDataFrame(list(enumerate(words)), "k bigint, word bigint"), fam, key="k").collect()}
        assert got == {i: (i, 1) for i in range(len(words))}


def test_render_transposes_on_request():
    fam = families.family("tag16h5")
    assert (families.render(fam, 3, transpose=True) == families.render(fam, 3).T).all()


# Image operators: both forms agree.


@pytest.fixture(scope="module")
def images(spark):
    return {(w, h): generators.noise(spark, w, h, 2).cache() for w, h in ((32, 32), (66, 37), (80, 77))}


@pytest.mark.parametrize("shape", [(32, 32), (66, 37), (80, 77)])
def test_forms_agree(spark, images, shape):
    px = images[shape]
    im = as_image(px).astype(np.uint8)
    kernel = gaussian_kernel(0.8)
    pairs = [
        (pixels.decimate(px, 2), kernels.decimate(im, 2)),
        (pixels.decimate(px, 3), kernels.decimate(im, 3)),
        (pixels.decimate_three_halves(px), kernels.decimate_three_halves(im)),
        (pixels.blur(px, kernel), kernels.blur(im, kernel)),
        (pixels.sharpen(px, kernel), kernels.sigma_filter(im, DetectorConfig(quad_sigma=-0.8))),
        (pixels.threshold(px, 200), kernels.threshold(im, 200)),
        (pixels.threshold(px, 200, full_blur=True), kernels.threshold(im, 200, full_blur=True)),
        (pixels.deglitch(pixels.threshold(px, 200)), kernels.deglitch(kernels.threshold(im, 200))),
    ]
    for ours, want in pairs:
        assert (as_image(ours) == want).all()
    assert (as_image(frames.unpack(frames.pack(px))) == im).all()


def test_components_and_points_agree(spark, images):
    t = pixels.threshold(images[66, 37], 240).cache()
    im = as_image(t).astype(np.uint8)
    a, b = kernels.component_edges(im)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((r["a"], r["b"]) for r in pixels.component_edges(t).filter("image_id = 0").collect())
    rep, size = kernels.components(im)
    lab = frames.labels(frames.pack(t)).filter("image_id = 0").collect()
    assert all(rep.ravel()[r["pix_id"]] == r["rep"] for r in lab)
    labelled = t.filter("image_id = 0").join(spark.createDataFrame([(i % 66, i // 66, int(rep.ravel()[i]), int(size.ravel()[i])) for i in range(im.size)], "x int, y int, rep bigint, size bigint"), ["x", "y"])
    got = sorted(tuple(r) for r in pixels.gradient_points(labelled, 3).select("c0", "c1", "x", "y", "gx", "gy").collect())
    assert got == sorted(map(tuple, kernels.gradient_points(im, rep, size, 3).tolist()))


def _points(im, rep):
    return kernels.gradient_points(im, rep, np.full(im.shape, 1000))


@pytest.mark.parametrize("swap", [False, True])
def test_edges_have_one_cluster(swap):
    im = np.zeros((10, 6), np.uint8)
    im[5:] = 255
    im = 255 - im if swap else im
    p = _points(im, (np.arange(10)[:, None] >= 5).astype(int) + np.zeros((1, 6), int))
    assert len({tuple(r) for r in p[:, :2]}) == 1 and set(p[:, 5]) == {-255 if swap else 255}
    p = _points(im[:, :6].T.copy(), (np.arange(10)[None, :] >= 5).astype(int) + np.zeros((6, 1), int))
    assert set(p[:, 4]) == {-255 if swap else 255}
    assert len(_points(np.full((5, 6), 127, np.uint8), np.zeros((5, 6), int))) == 0
    assert len(kernels.gradient_points(im, np.zeros(im.shape, int), np.ones(im.shape, int))) == 0


def test_three_halves_and_sizes():
    assert kernels.decimate_three_halves(np.arange(20 * 17, dtype=np.int64).reshape(20, 17).astype(np.uint8)).shape == (12, 10)
    assert DetectorConfig(quad_decimate=1.2).decimation() == 0 and DetectorConfig(quad_decimate=1.5).decimation() == 1.5 and DetectorConfig(quad_decimate=2.5).decimation() == 3
    assert gaussian_kernel(0.2) is None and len(gaussian_kernel(0.8)) == 3 and abs(sum(gaussian_kernel(1.5)) - 255) <= 3


# Detection.


def scene(fam, id_, turn, scale, x=13, y=14, gray=128):
    tag = np.kron(np.rot90(families.render(fam, id_), turn), np.ones((scale, scale), np.uint8))
    im = np.full((len(tag) + 31, len(tag) + 33), gray, np.uint8)
    im[y : y + len(tag), x : x + len(tag)] = tag
    return im


@pytest.mark.parametrize("name", ["tag16h5", "tag25h9", "tagCircle21h7"])
@pytest.mark.parametrize("changes", [{}, {"quad_decimate": 2.0}, {"quad_decimate": 1.5}, {"quad_sigma": 0.8}, {"refine_edges": False}])
def test_rendered_tags_are_found(name, changes):
    fam = families.family(name)
    for id_ in range(0, 30, 7):
        for turn in range(4):
            (d,) = detect_one(scene(fam, id_, turn, 7), DetectorConfig(**changes), [_Reader(fam, 1)])
            assert (d["id"], d["family"]) == (id_, name) and d["hamming"] <= fam.reversed_border


def test_corners_are_close():
    fam = families.family("tag25h9")
    (d,) = detect_one(scene(fam, 4, 0, 7), DetectorConfig(), [_Reader(fam, 1)])
    want = np.array([(13 + 7, 14 + 56), (13 + 56, 14 + 56), (13 + 56, 14 + 7), (13 + 7, 14 + 7)])
    got = np.array(d["corners"])
    assert min(np.abs(np.roll(got, i, 0) - want).max() for i in range(4)) < 1  # whichever corner comes first


def test_two_images_and_small_ones(spark):
    fam = families.family("tag25h9")
    ims = {1: scene(fam, 3, 1, 6), 2: scene(fam, 9, 2, 7), 3: np.zeros((7, 9), np.uint8), 4: np.full((40, 40), 90, np.uint8)}
    found = DetectorBuilder().add_family(fam, 1).build().detect(generators.from_arrays(spark, ims)).collect()
    assert sorted((r["image_id"], r["id"]) for r in found) == [(1, 3), (2, 9)]
    with pytest.raises(ValueError):
        generators.from_arrays(spark, {1: np.zeros((3, 3, 3), np.uint8)})


def test_reconcile_keeps_the_better():
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a, b, c = ({"hamming": h, "margin": m, "corners": box(*p)} for h, m, p in ((1, 50.0, (0, 0, 10)), (0, 20.0, (5, 5, 10)), (0, 30.0, (40, 40, 5))))
    assert reconcile.greedy([a, b, c]) == [b, c]
    inside = {"hamming": 0, "margin": 90.0, "corners": box(6, 6, 2)}
    assert reconcile.greedy([b, inside]) == [inside]


# Pose.


def test_pose_of_a_known_camera():
    cam = Camera(0.16, 600, 610, 320, 240)
    rng = np.random.default_rng(3)
    for _ in range(20):
        q = np.array([1.0, *(rng.normal(0, 0.35, 3))])
        r = algebra.from_quaternion(q / np.linalg.norm(q))
        t = np.array([rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), rng.uniform(0.8, 2)])
        p = pose.object_points(cam) @ r.T + t
        corners = np.stack([cam.fx * p[:, 0] / p[:, 2] + cam.cx, cam.fy * p[:, 1] / p[:, 2] + cam.cy], 1)
        h = kernels.homography(corners, np.array([(-1, 1), (1, 1), (1, -1), (-1, -1)], np.float64))
        found, _ = pose.solutions(h, corners, cam)
        best = min(found, key=lambda s: s[2])
        assert best[2] < 1e-8 and np.abs(best[1] - t).max() < 1e-3 and np.abs(best[0] - r).max() < 1e-2


# Sources and sinks.


def test_anymaps(spark, tmp_path):
    rng = np.random.default_rng(2)
    gray, rgb = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (pnm.parse(pnm.write(gray)) == gray).all() and (pnm.parse(pnm.write(rgb)) == rgb).all()
    wide = b"P5 # size\n# more\n2 1\n65535\n" + bytes([1, 2, 200, 3])
    assert pnm.parse(wide).tolist() == [[258, 51203]] and pnm.to_luma(pnm.parse(wide)).tolist() == [[1, 200]]
    assert pnm.parse(b"P4\n9 2\n" + bytes([0x80, 0x80, 0, 0])).tolist() == [[0] + [255] * 7 + [0], [255] * 9]
    assert pnm.to_luma(np.array([[[255, 255, 255], [4, 8, 2]]], np.uint8)).tolist() == [[255, 5]]
    for bad in (b"P3 1 1 255\n0", b"P5 2 2 255\nab", b"P5 2 2 99\nabcd", b"P5 2"):
        with pytest.raises(pnm.PnmError):
            pnm.parse(bad)
    out = f"file://{tmp_path}/im"
    assert pnm.save_frames(generators.from_arrays(spark, {1: gray, 2: gray.T.copy()}), out) == 2
    back = {r["path"].rsplit("/")[-1]: (r["width"], r["height"], bytes(r["data"])) for r in pnm.read_frames(spark, out).collect()}
    assert back == {"1.pnm": (7, 5, gray.tobytes()), "2.pnm": (5, 7, gray.T.tobytes())}
    spark.dataSource.register(pnm.PnmSource)
    assert {bytes(r["data"]) for r in spark.read.format("pnm").load(f"{tmp_path}/im").collect()} == {gray.tobytes(), gray.T.tobytes()}
    with pytest.raises(FileNotFoundError):
        pnm.read_frames(spark, out, "*.none")


def test_strides_and_postscript(spark):
    df = spark.createDataFrame([(1, 2, 2, bytearray(b"ab__cd__"), 4)], "image_id bigint, width int, height int, data binary, stride int")
    assert bytes(generators.from_strided(df).first()["data"]) == b"abcd"
    page = records.postscript(np.zeros((2, 3), np.uint8), [(0, 0, 1, 1)])
    assert page.startswith("%!PS") and "0 2 moveto 1 1 lineto stroke" in page and page.rstrip().endswith("showpage")
    assert records.draw_line(np.zeros((4, 4), np.uint8), (0, 0), (3, 3)).diagonal().tolist() == [255] * 4


def test_records_skip_bad_lines(spark, tmp_path):
    good = '{"label":"a","images":[{"image_id":1,"iterations":[{"iter":0,"wall":5,"stages":{"x":2,"y":3}}]}]}'
    (tmp_path / "r.jsonl").write_text(f"{good}\n\n{{broken\n   \n" + '{"images":[]}\n')
    assert sorted((r["label"], r["stage"], r["stage_wall"]) for r in records.read_runs(spark, f"{tmp_path}/r.jsonl").collect()) == [("a", "x", 2), ("a", "y", 3)]


def test_config_files(tmp_path):
    (tmp_path / "c.toml").write_text('label = "x"\n[detector]\nquad_decimate = 3.0\n')
    c = load_config(str(tmp_path / "c.toml"))
    assert c["quad_decimate"] == 3.0 and c["hamming"] == 1 and c["label"] == "x"


def test_checkerboard(spark):
    im = as_image(generators.checkerboard(spark, 8, 6, 2))
    assert im[0, :4].tolist() == [0, 0, 255, 255] and im[2, 0] == 255
    assert as_image(generators.ramp(spark, 20, 20))[19, 19] == 399 % 256


def test_stream(spark, tmp_path):
    from tesserae.streaming.frames import detect_stream, frame_stream

    fam = families.family("tag25h9")
    generators.from_arrays(spark, {i: scene(fam, i, i % 4, 6) for i in range(6)}).write.parquet(f"{tmp_path}/in")
    detect_stream(DetectorBuilder().add_family(fam, 1).build(), frame_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r["image_id"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(i, i) for i in range(6)]


# Numeric functions.


def test_geometry():
    sq = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert geometry.segment_intersection((0, 0), (4, 4), (0, 4), (4, 0)) == (2, 2)
    assert geometry.segment_intersection((0, 0), (1, 1), (0, 4), (4, 0)) is None and geometry.line_intersection((0, 0), (1, 1), (0, 4), (4, 0)) == (2, 2)
    assert geometry.line_intersection((0, 0), (1, 0), (0, 1), (1, 1)) is None
    assert geometry.convex_hull([*sq, (2, 2), (1, 3)]) == [(0, 0), (4, 0), (4, 4), (0, 4)] and geometry.area(geometry.make_ccw(sq[::-1])) == 16
    assert geometry.contains_point(sq, (1, 1)) and not geometry.contains_point(sq, (5, 1))
    assert geometry.contains_polygon(sq, [(1, 1), (2, 1), (2, 2)]) and geometry.overlap(sq, [(3, 3), (9, 3), (9, 9)]) and not geometry.overlap(sq, [(5, 5), (9, 5), (9, 9)])
    assert geometry.closest_boundary_point(sq, (2, -3)) == (2, 0) and geometry.rasterize(sq, 2) == [0, 4]


def test_points_inside_concave_polygons():
    from tesserae.functions import geometry

    notched = [[(0, 0), (2, 1), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 0.5), (0, 4)], [(0, 0), (1, 0), (1, 3), (5, 3), (5, 4), (0, 4)]]
    for poly in notched:
        for own in (poly, poly[::-1], poly[2:] + poly[:2]):
            assert geometry.contains_point(own, geometry.interior_point(own))
    u = [(0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5)]
    within = [(2, 2), (3, 2), (3, 3), (2, 3)]  # in the opening of the U, outside it
    assert not geometry.overlap(u, within) and not geometry.overlap(within, u)
    assert geometry.overlap(u, [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)])


def test_algebra():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 9):
        a = rng.normal(size=(n, n))
        p, low, up, _ = algebra.plu(a)
        assert np.allclose(a[p], low @ up) and math.isclose(algebra.det(a), np.linalg.det(a), rel_tol=1e-9)
        assert np.allclose(algebra.cholesky_solve(a @ a.T + np.eye(n), np.ones(n)), np.linalg.solve(a @ a.T + np.eye(n), np.ones(n)))
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    assert np.allclose(algebra.MatrixExpression("(M-2M')^-1 * M")(a, b, b), np.linalg.inv(a - 2 * b.T) @ b)
    assert np.allclose(algebra.MatrixExpression("F M + -M")(3, a, b), 3 * a - b)
    for bad in ("M +", "(M", "M $", ")"):
        with pytest.raises(ValueError):
            algebra.MatrixExpression(bad)(*[a] * bad.count("M"))
    with pytest.raises(ValueError):
        algebra.MatrixExpression("M")()
    assert np.allclose(algebra.Poly([-6, 11, -6, 1]).real_roots(), [1, 2, 3]) and algebra.Poly([1, 0, 1]).real_roots() == []
    assert algebra.Poly([1, 2, 3])(2) == 17 and algebra.Poly([1, 2, 3]).derivative().c == [2, 6]
    assert math.isclose(algebra.mod2pi(7), 7 - 2 * math.pi) and algebra.lcm(4, 6) == 12 and algebra.gcd(12, 18) == 6
    h = np.array([[1.1, 0.2, 5], [0.1, 0.9, 3], [0.001, 0.002, 1]])
    src = rng.uniform(-1, 1, (9, 2))
    assert np.allclose(kernels.fit_homography(src, kernels.project(h, src)), h)


def test_stacks_give_what_single_frames_give(monkeypatch):
    fams = [families.family(n) for n in ("tag25h9", "tag36h11")]
    readers = [_Reader(f, 1) for f in fams]
    images = [scenes.pair_scene(k, *fams) for k in range(12)] + [np.full((40, 40), 90, np.uint8), np.zeros((5, 5), np.uint8)]
    config = DetectorConfig(quad_sigma=-0.8)
    alone = [detect_one(im, config, readers) for im in images]
    assert sum(map(len, alone)) >= 20
    for most in (1, 30000, 1 << 18):
        monkeypatch.setattr(kernels, "STACK", most)
        seen = []
        for places in kernels.stacks(images):
            seen += places
            assert detect_stack(np.stack([images[i] for i in places]), config, readers) == [alone[i] for i in places]
        assert sorted(seen) == list(range(len(images)))


def test_image_files_as_a_stream(spark, tmp_path):
    fam = families.family("tag25h9")
    images = {k: scenes.scene(k, fam) for k in range(5)}
    colour = {k: np.stack([im] * 3, -1) for k, im in images.items()}
    for of in (generators.from_colour(spark, colour), generators.from_colour(spark, colour, "bgr")):
        assert pnm.save_frames(of, f"file://{tmp_path}/in") == 5
    assert sorted(p.name for p in (tmp_path / "in").iterdir() if p.suffix != ".crc") == [f"{k}.pnm" for k in range(5)]
    blue = {1: np.dstack([np.full((9, 9), 200, np.uint8), np.zeros((9, 9, 2), np.uint8)])}
    assert {pnm.to_luma(blue[1])[0, 0], bytes(generators.from_colour(spark, blue, "bgr").first()["data"])[0]} == {50}
    found = main.detector(main.parser().parse_args(["detect", "", "--family", "tag25h9:1", "--family", "tag36h11", "--sigma", "-0.8"]))
    assert [(f.name, e) for f, e in found.families] == [("tag25h9", 1), ("tag36h11", 2)] and found.config.quad_sigma == -0.8
    for most, want in ((None, [0, 1, 2, 3, 4]), (3, None)):
        out = str(tmp_path / f"out{most}")
        stream.detect_stream(found, stream.image_stream(spark, str(tmp_path / "in"), files_per_batch=2, max_frames=most), out, str(tmp_path / f"check{most}")).awaitTermination()
        ids = sorted(r["id"] for r in spark.read.parquet(out).collect())
        assert ids == want if want else len(ids) == 3


def test_malformed_lines_are_counted(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"label": "x", "images": []}\n\nnot json\n{"images": []}\n')
    (tmp_path / "b.jsonl").write_text('{"label": "y", "images": []}\n')
    (row,) = records.malformed(spark, str(tmp_path)).collect()
    assert row["lines"] == 2 and row["path"].endswith("a.jsonl")


def test_stacks_of_poses():
    cam, rng = Camera(0.1, 600, 620, 320, 240), np.random.default_rng(5)
    source = np.array([(-1, 1), (1, 1), (1, -1), (-1, -1)], np.float64)
    corners = np.array([(300, 260), (360, 255), (355, 200), (298, 205)], float) + rng.normal(0, 4, (30, 4, 2))
    h, sound = kernels.homographies(corners, source)
    assert sound.all() and pose.solve_all(h[:0], corners[:0], cam) == []
    for one, (found, why) in zip(zip(h, corners, strict=True), pose.solve_all(h, corners, cam), strict=True):
        want, reason = pose.solutions(*one, cam)
        assert why == reason and len(found) == len(want)
        for a, b in zip(found, want, strict=True):
            assert all(np.allclose(p, q) for p, q in zip(a, b, strict=True)) and np.isclose(np.linalg.det(a[0]), 1)
    # After many steps the translation is the best for its rotation, and the error is that of both.
    for one, (found, _) in zip(corners, pose.solve_all(h, corners, cam, 5000), strict=True):
        for r, t, error in found:
            v, p = pose.rays(one, cam), pose.object_points(cam) @ r.T
            off = [sum(np.linalg.norm(np.cross(ray, q + t + d)) ** 2 / (ray @ ray) for ray, q in zip(v, p, strict=True)) for d in (np.zeros(3), *np.eye(3) * 1e-4, *np.eye(3) * -1e-4)]
            assert np.isclose(off[0], error) and min(off[1:]) >= error


def test_merging_finds_the_corners():
    fam = families.family("tag25h9")
    im = scene(fam, 4, 0, 7)
    t = kernels.threshold(im)
    p = kernels.gradient_points(t, *kernels.components(t))
    own = max((p[(p[:, :2] == k).all(1)] for k in np.unique(p[:, :2], axis=0)), key=len)[:, 2:]
    x, y, gx, gy = own.T
    order = np.lexsort((gy, gx, x, y, kernels.slope_keys(x, y)))
    prefix = kernels.prefix_moments(im, x[order], y[order])
    corners = kernels.merged_corners(prefix, QuadParams())
    at = np.stack([x[order], y[order]], 1)[list(corners)] / 2
    box = np.array([(x.min(), y.min()), (x.max(), y.min()), (x.max(), y.max()), (x.min(), y.max())]) / 2
    assert all(np.abs(at - c).sum(1).min() < 6 for c in box)


def test_bayer_forms_agree(spark, images):
    px = images[66, 37]
    assert (as_image(pixels.threshold_bayer(px)) == kernels.bayer_threshold(as_image(px).astype(np.uint8))).all()


def test_steps_and_limits(spark):
    fam = families.family("tag25h9")
    found = DetectorBuilder(DetectorConfig(quad_decimate=2.0, qtp=QuadParams(deglitch=True))).add_family(fam, 1).build()
    steps = found.debug(generators.from_arrays(spark, {1: scene(fam, 3, 1, 6)})).collect()
    assert [r["step"] for r in steps] == ["source", "decimated", "filtered", "threshold", "deglitched", "components"]
    with pytest.raises(ConfigError):
        kernels.check_size((10, 40000))
    h = kernels.homography(np.array([(10, 10), (50, 10), (50, 50), (10, 50)], float))
    assert pose.model_view(h, Camera(0.1, 100, 100, 30, 30)).shape == (4, 4)


def test_quads_are_checked():
    square = np.array([(0, 0), (40, 0), (40, 40), (0, 40)], float)
    assert kernels.valid_quad(square, 8, QuadParams()) and not kernels.valid_quad(square, 50, QuadParams()) and not kernels.valid_quad(square[::-1], 8, QuadParams())


def test_incomplete_beta():
    assert np.allclose(analytics.incomplete_beta(2, 3, 0.4), 0.5248) and np.allclose(analytics.incomplete_beta(5, 0.5, 10 / (10 + 2.228139**2)), 0.05, atol=1e-6)


# Queries.

ENTRY = __import__("__spark_entry__")
NAMES = sorted(n for n in ENTRY.queries() if n in ENTRY.oracle_sql() and not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    norm = lambda rows: sorted(repr([None if v is None else round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    df = ENTRY.queries()[name](spark, "/root/testdata/sf0.001")
    want = duck.sql(ENTRY.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert norm(tuple(r) for r in df.select(*columns).collect()) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert ENTRY.entry(spark).count() == 200
