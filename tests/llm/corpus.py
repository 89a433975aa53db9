"""Small corpora for the tests of the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, a second spelling of a name they read, and no type alike.
EXTRA = "h long, place string, `print` string, rank int, n_words string, size double, anchor string, key int, Text string, c0 int, kept int, taken string"
EXTRA_VALUES = (1, "x", "p", 2, "w", 0.5, "a", 3, "other", 4, 0, "t")

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea kid body information back parent face others level office door health person art war history party result change morning reason research girl guy moment air teacher force education".split()


def sentence(rng, n=10):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def prose(rng, paragraphs=4, sentences=4):
    return "\n".join(" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(sentences)) for _ in range(paragraphs))


def documents(seed=1, n=40):
    """Prose with copies, near copies, shared passages, empty and odd texts, repeated
    rows, null ids, one hot source, and sources and languages that are null."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 6)) for _ in range(n)]
    passage = prose(rng, 1, 12)
    texts += [texts[0], texts[0], texts[1] + " Extra words at the end.", texts[2].replace("the", "a")]
    texts += [t + "\n" + passage for t in texts[3:6]] + [passage, None, "", " \n\t ", "one", "two words", "ÀÉ ñ 漢字 😀 ß", "word " * 400, "\n".join(["same line here"] * 30)]
    rows = [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else rng.choice(["a", "b", None]), None if t is None else len(t))
            for i, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "no id at all", "en", "hot", 12), (None, None, None, None, None)]


def frame(spark, rows=None, extra=False, parts=3):
    rows = documents() if rows is None else rows
    if extra:
        return spark.createDataFrame([(*r, *EXTRA_VALUES) for r in rows], f"{SCHEMA}, {EXTRA}").repartition(parts)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)
