"""Template words against the plain patterns, and window hashes against equal words."""

import re

from tidemark.llm import decontaminate as D

TEXTS = [
    "", "   ", "a", "Twenty-one men (and 3 km) of Paris.", "\tThe The. the Anna's 'Quoted' -5 +-7x --- 12 kg\n", "one two  three seven-up eleven ELEVEN thirty-Nine thirty-ten Tenfold",
    "1 2 3 4 5 6", "Find Finder Éclair ÉTÉ McX X Xy €5 ~7 −3 b5 12% (7) $9", "5 mm 6 Hours 7 hourses 8 C", "...Anna... ,9, a.b ;;", "seventy six\x0bSix\x0cHundred \r90 s",
]


def plain_words(text):
    p = re.escape(".,;:!?()[]{}\"'|#&$%*<>")
    words = [re.sub(rf"^[{p}]+|[{p}]+$", "", w, flags=re.A) for w in re.split(r"[ \t\n\x0b\f\r]+", text)]
    words = [w for w in words if w]
    number = re.compile(rf"[-+−–~€£]{{0,2}}[0-9].*|(?i:(?:{'|'.join(D.TENS)})(?:-(?:{'|'.join(D.ONES[1:10])}))?|{'|'.join(D.ONES)})", re.A)
    out = [D.NUMBER if number.fullmatch(w) else w for w in words]
    out = [D.UNIT if i and out[i - 1] == D.NUMBER and w.lower() in D.UNITS else w for i, w in enumerate(out)]
    named = [D.NAME if re.match("[A-ZÀ-Þ]", w) and w not in D.COMMON and any(c.islower() for c in w) else w for w in out]
    return [w.lower() for w in named], [w.lower() for w in out], words


def test_template_words(spark):
    rows = D.templates(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")).withColumn("words", D.words_of(D.F.col("bare"))).collect()
    for r in rows:
        assert (r.form, r.plain, r.words) == plain_words(TEXTS[r.i]), TEXTS[r.i]


def test_window_hashes(spark):
    texts = ["a b c d e f", "x a b c d e", "a b c d", "a b c d", "a b c", ""]
    made = {r.i: r.form_w for r in D.with_windows(D.templates(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), 5).collect()}
    assert [len(made[i]) for i in range(6)] == [2, 2, 1, 1, 1, 0]
    assert made[0][0] == made[1][1] and made[2] == made[3] and len({made[0][0], made[0][1], made[1][0], made[2][0], made[4][0]}) == 5
