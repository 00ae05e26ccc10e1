"""Image-vector operators against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from votelens.functions import scalars, vectors as V
from votelens.plans import learning as L


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 36))
    x[0, 3], x[1, :] = 0.0, 0.0
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").persist()


def got(df, column="x"):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_background_subtract_small_case(spark, images):
    x, df = images

    def one(v):
        sd = v.std()
        n = np.where(v == 0, 0, np.sign(v) * np.log1p(np.abs(v) / (sd or 1)))
        img = n.reshape(6, 6, order="F")
        k = np.exp(-.5 * np.arange(-4, 5) ** 2.0)
        k /= k.sum()
        ref = [0, 1, 2, 3, 4, 5]
        mirror = lambda i: ref[i] if 0 <= i < 6 else ref[-i - 1] if i < 0 else ref[11 - i]
        for _ in range(2):
            img = np.array([[sum(k[d + 4] * img[mirror(r + d)][c] for d in range(-4, 5)) for c in range(6)] for r in range(6)]).T
        seed = img.copy()
        seed[1:-1, 1:-1] = img.min()
        while True:
            grown = seed.copy()
            for r in range(6):
                for c in range(6):
                    grown[r, c] = min(seed[max(r - 1, 0):r + 2, max(c - 1, 0):c + 2].max(), img[r, c])
            if (grown == seed).all():
                return (img - seed).ravel(order="F")
            seed = grown

    out = got(V.background_subtract(df, "id", "x", 6))
    assert out == pytest.approx(np.array([one(v) for v in x]), abs=1e-9)


def test_rotations_match_numpy(spark, images):
    x, df = images
    rows = V.rotate_augment(df, "x", 6).collect()
    assert len(rows) == 24
    for r in rows:
        want = np.rot90(x[r.id].reshape(6, 6, order="F"), r.turn).ravel(order="F")
        assert r.x == pytest.approx(want)


def test_convolve_and_pool(spark, images):
    x, df = images
    bank = np.random.default_rng(1).normal(size=(2, 9))
    out = {(r.id, r.filter): r.response for r in V.convolve(df, "id", "x", 6, bank, 3, pool=2).collect()}
    for (k, f), v in out.items():
        img, w = x[k].reshape(6, 6, order="F"), bank[f].reshape(3, 3, order="F")
        resp = np.array([[np.sqrt((img[i:i + 3, j:j + 3] * w).sum() ** 2 + 1e-8) for j in range(4)] for i in range(4)])
        want = np.array([[resp[a:a + 2, b:b + 2].sum() for b in (0, 2)] for a in (0, 2)])
        assert v == pytest.approx(want.ravel(order="F"))


def test_normalisations(spark, images):
    x, df = images
    assert got(df.select("id", V.sign_log_norm(F.col("x")).alias("x")))[1] == pytest.approx(np.zeros(36))
    c = x[2] - x[2].mean()
    c /= np.abs(c).max()
    assert got(df.select("id", V.feature_standardise(F.col("x")).alias("x")))[2] == pytest.approx(c / c.std())
    assert got(df.select("id", V.centre_crop(F.col("x"), 6, 1).alias("x")))[3] == pytest.approx(
        x[3].reshape(6, 6, order="F")[2:4, 2:4].ravel(order="F"))
    odd = df.limit(1).select(V.nan_to_num(F.array(*[F.lit(v) for v in (float("nan"), float("inf"), float("-inf"), 2.0)])).alias("x")).first().x
    assert odd == [0.0, V.LARGEST, -V.LARGEST, 2.0]


def test_grouped_split_cuts_no_group(spark):
    df = spark.createDataFrame([(k, f"g{k // 4}", k % 2) for k in range(80)], "id long, grp string, y int")
    rows = L.grouped_split(df, "grp").collect()
    assert len(rows) == 80
    for y in (0, 1):
        mine = [r for r in rows if r.y == y]
        sides = {}
        for r in mine:
            sides.setdefault(r.grp, set()).add(r.split)
        assert all(len(s) == 1 for s in sides.values())
        train = sum(r.split == "train" for r in mine)
        assert 30 < train <= 32
    one = spark.createDataFrame([(k, "only", 1) for k in range(5)], "id long, grp string, y int")
    assert {r.split for r in L.grouped_split(one, "grp").collect()} == {"train"}


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(18.0,), (18.01,), (23.0,), (float("nan"),)], "m double")
    out = [r[0] for r in df.select(scalars.mag_bin(F.col("m"))).collect()]
    assert out[:3] == [18.0, 19.0, 23.0] and np.isnan(out[3])
    with pytest.raises(Exception):
        spark.createDataFrame([(23.5,)], "m double").select(scalars.mag_bin(F.col("m"))).collect()


def test_online_softmax_replay(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(v.tolist(), int(v[0] > 0)) for v in x], "x array<double>, y int")
    # one partition and a batch of all rows: a pass is one step
    m = L.OnlineSoftmax(spark, str(tmp_path), 2, 3, rate=.5, lam=0.0, batch=1000).start()
    for b in (0, 1, 1):
        m.process(df.coalesce(1), b)
    y, w = (x[:, 0] > 0).astype(int), np.zeros((2, 4))
    xb = np.c_[np.ones(40), x]
    for _ in range(2):
        p = np.exp(xb @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(40), y] -= 1
        w -= .5 * p.T @ xb / 40
    r = m.weights().first()
    assert r.steps == 2 and np.array(r.w) == pytest.approx(w)
