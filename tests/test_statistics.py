"""Student's quantiles against published values, the one-sided signed-rank test, refused fits, archives."""

import io
import tarfile

import pytest


def test_student_quantiles():
    from lodestone.operators.stats import student_quantile

    published = {1: 12.706, 2: 4.303, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}
    assert {n: round(student_quantile(n), 3) for n in published} == published


def test_signed_rank_is_one_sided():
    from lodestone.operators.stats import signed_rank_p

    lower = [[("a", -1.0)], [("a", -2.0)], [("a", -3.0)]]
    higher = [[(s, -d) for s, d in b] for b in lower]
    assert signed_rank_p(lower) == 1 / 8 and signed_rank_p(higher) == 1


def test_the_only_ply_of_an_archive(spark, tmp_path):
    from lodestone.sources.readers import read_cloud

    ply = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, content in (("readme.txt", b"x"), ("d/cloud.ply", ply)):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    rows = read_cloud(spark, str(tmp_path / "a.tar.gz")).orderBy("raw_index").collect()
    assert [(r["x"], r["y"], r["z"]) for r in rows] == [(1, 2, 3), (4, 5, 6)]


def test_flips_in_ranges_are_the_batch_test(spark):
    import random

    from lodestone.operators import stats

    draw = random.Random(3)
    rows = [(f"s{k % 2}", f"b{k % 7}", round(draw.gauss(-0.3, 1), 1)) for k in range(60)]
    df = spark.createDataFrame(rows, "stratum string, block string, delta double")
    sums = stats.signed_rank_sums(df, ["stratum"], ["block"], "delta")
    got = stats.flipped_share(sums, "signed").first()
    blocks = [[(s, d) for s, b, d in rows if b == name] for name in sorted({r[1] for r in rows})]
    assert got["blocks"] == 7 and got["p"] == pytest.approx(stats.signed_rank_p(blocks))
    many = spark.createDataFrame([(float(k),) for k in range(31)], "signed double")
    with pytest.raises(ValueError, match="more than 30"):
        stats.flipped_share(many, "signed")
    assert stats.sign_test(3, 0) == 1 / 8 and stats.sign_test(0, 0) == 1


def test_resamples_do_not_depend_on_how_rows_are_dealt(spark):
    from lodestone.operators import stats

    df = spark.createDataFrame([(k % 2, k, float(k * k % 13)) for k in range(30)], "stratum int, at int, v double")
    a, b = (sorted(map(tuple, stats.resampled(d, ["stratum"], "at", "v", 20, 5).collect())) for d in (df, df.repartition(7)))
    assert [x[0] for x in a] == list(range(20)) and len({x[1] for x in a}) > 10
    assert [[round(v, 9) for v in x] for x in a] == [[round(v, 9) for v in x] for x in b]
    low = stats.resampled_interval(df, ["stratum"], "at", "v", 40, 5).first()
    assert low["mean_low"] <= low["mean"] <= low["mean_high"] and low["n"] == 30


def _plain(rows, draws, seed):
    """Mean and median of each resample, one draw after the other."""
    import hashlib
    import statistics

    strata = {}
    for s, at, v in sorted(rows):
        strata.setdefault(s, []).append(v)
    out = {}
    for b in range(draws):
        said = lambda s, i: int(hashlib.md5(f"{seed}:{b}:{s}:{i}".encode()).hexdigest()[:8], 16)
        drawn = [vs[said(s, i) % len(vs)] for s, vs in strata.items() for i in range(len(vs))]
        some = [v for v in drawn if v is not None]
        out[b] = (sum(some) / len(some), statistics.median(some)) if some else (None, None)
    return out


@pytest.mark.parametrize("reach, tabled", [(4, 1 << 20), (0, 1 << 20), (4, 10)])
def test_resamples_are_those_of_plain_draws(spark, monkeypatch, reach, tabled):
    """Also where medians lie outside the first band, values are missing or tie, and rows meet draws by a shuffle."""
    from lodestone.operators import stats

    monkeypatch.setattr(stats, "TABLED", tabled)
    rows = [(k % 3, k, None if k % 11 == 0 else float(k * k % 17) - 8) for k in range(200)]
    df = spark.createDataFrame(rows, "stratum int, at int, v double")
    got = {r["draw"]: (r["mean"], r["median"]) for r in stats.resampled(df, ["stratum"], "at", "v", 30, 5, reach).collect()}
    expected = _plain(rows, 30, 5)
    assert got.keys() == expected.keys()
    for b, (mean, median) in expected.items():
        assert got[b] == (pytest.approx(mean), median)


def test_an_interval_counts_rows_without_a_value(spark):
    from lodestone.operators import stats

    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("b", 2, 3.0), ("b", 3, 5.0)], "stratum string, at int, v double")
    got = stats.resampled_interval(df, ["stratum"], "at", "v", 40, 5).first()
    assert (got["n"], got["median"]) == (4, 3.0) and got["mean"] == pytest.approx(10 / 3)
    ends = sorted(m for m, _ in _plain([("a", 0, None), ("a", 1, 2.0), ("b", 2, 3.0), ("b", 3, 5.0)], 40, 5).values())
    assert (got["mean_low"], got["mean_high"]) == (pytest.approx(ends[1]), pytest.approx(ends[39]))
    empty = stats.resampled_interval(df.filter("false"), ["stratum"], "at", "v", 40, 5).first()
    assert empty["n"] == 0 and empty["median"] is None and empty["mean_low"] is None
