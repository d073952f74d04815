import pytest
from pyspark.sql import functions as F

from mediasieve.functions import scalars as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (10240, "10 KB"), (1536, "1.5 KB"), (5 * 1024**2, "5.0 MB"), (3000 * 1024**3, "3000 GB")])
def test_human_size(spark, n, text):
    assert one(spark, S.human_size(F.lit(n)))[0] == text


@pytest.mark.parametrize(("n", "want"), [(100.5, 100), (101.5, 102), (7.0, 6), (1280.0, 1280)])
def test_even_rounds_half_to_even_first(spark, n, want):
    assert one(spark, S.even(F.lit(n)))[0] == want


@pytest.mark.parametrize(
    ("path", "formats", "reason"),
    [
        ("a/my-reel-1.png", ["916"], "filename matched 'reel'"),
        ("a/my_reel_1.png", ["45", "916"], "default"),
        ("a/a916b.png", ["916"], "filename matched '916'"),
        ("a/x9160.png", ["45", "916"], "default"),
        ("a/post reel.png", ["45", "916"], "filename matched both tokens"),
        ("Stories/x/y.png", ["916"], "input subfolder"),
        ("feed/y.png", ["45"], "input subfolder"),
        ("y.png", ["45", "916"], "default"),
    ],
)
def test_route(spark, path, formats, reason):
    assert list(one(spark, *S.route(F.lit(path)))) == [formats, reason]


@pytest.mark.parametrize(("flag", "formats"), [("both", ["45", "916"]), ("45", ["45"])])
def test_flag_wins(spark, flag, formats):
    assert one(spark, S.route(F.lit("reels/reel.png"), flag)[0])[0] == formats


@pytest.mark.parametrize(("text", "box", "bad"), [("1:2:3:4", (1, 2, 3, 4), None), ("1,2,3,4", (1, 2, 3, 4), None), ("1:2:3", None, "expected"), ("a:2:3:4", None, "whole"), ("1:2:0:4", None, "positive"), (None, None, "expected")])
def test_parse_box(spark, text, box, bad):
    got, error = one(spark, *(c.alias(n) for c, n in zip(S.parse_box(F.lit(text).cast("string")), "be")))
    assert (tuple(got) if got else None) == box
    assert error is None if bad is None else bad in error


@pytest.mark.parametrize(("rel", "out"), [("ok.png", False), ("../secret.txt", True), ("/etc/x", True), ("a/../../b", True), ("a/../b", False), (".", False)])
def test_escapes(spark, rel, out):
    assert one(spark, S.escapes(F.lit(rel)))[0] is out


def test_short_error(spark):
    say = lambda m: one(spark, S.short_error(F.lit(m).cast("string"), F.lit("OSError")))[0]
    assert say(None) == say(" ") == "OSError"
    assert say("bad Traceback (most") == "bad" and say("Traceback") == "Processing failed."
    assert say("x" * 280) == "x" * 280 and say("x" * 281) == "x" * 277 + "…"


@pytest.mark.parametrize(("path", "stem", "ext", "kind"), [("a/b.JPG", "b", "jpg", "image"), ("a.b/c", "c", "", None), (".png", ".png", "", None), ("x.tar.mp4", "x.tar", "mp4", "video")])
def test_names(spark, path, stem, ext, kind):
    p = F.lit(path)
    assert list(one(spark, S.stem(p), S.extension(p), S.media_kind(p))) == [stem, ext, kind]
