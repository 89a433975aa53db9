"""Personal data by weak supervision.

Loose patterns propose spans. Labelers with different knowledge (strict patterns,
checksums, gazetteers, the text before, the text after, the surroundings) vote on each;
expectation-maximisation over the counts of vote patterns estimates how reliable every
labeler is and how likely each pattern is personal data; a logistic classifier of the
span's features is trained on those probabilities and decides. Spans of the base
patterns are personal data whatever it says.

One pass over the texts counts vote patterns and feature cells, both from fixed sets,
so that a bounded table reaches the driver; a second pass applies the classifier.
"""

import hashlib
import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flowgauge.llm.shared import add_columns, pick, positions
from flowgauge.session import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "name", "secret", "ssn")

# The base patterns, written so that no text takes quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Loose patterns of the proposals.
LOOSE_PHONE = re.compile(r"\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b")
LOOSE_SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
LOOSE_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,4}")
ACCESS_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{12,}\b")
SECRET_VALUE = re.compile(r"[=:] {0,2}[\"']?([^\s\"',;]{6,})")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña)\.? ((?:[A-ZÀ-ÖØ-Þ][\w'-]+)(?: [A-ZÀ-ÖØ-Þ][\w'-]+){0,2})")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}")

# Gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Sr", "Don")
SECRET_WORDS = ("password", "passwd", "pwd", "passwort", "token", "secret", "api_key", "apikey", "api-key", "contraseña")
CLUES = {
    "email": ("mail", "contact", "kontakt", "correo", "write to"),
    "ip": ("ip", "host", "server", "address", "login from"),
    "card": ("card", "visa", "karte", "tarjeta", "carte", "credit"),
    "phone": ("tel", "phone", "call", "fax", "mobil", "anruf"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"),
    "name": ("name", "dear", "liebe", "querid", "cher"),
    "secret": (*SECRET_WORDS, "key", "akia"),
    "ssn": ("ssn", "social", "security"),
}
ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "eu", "io", "info")


def luhn(digits):
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code):
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(text):
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def base_spans(text):
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out = []
    last = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def proposals(text):
    """Spans worth a vote: (kind, start, end), the base ones among them."""
    out = base_spans(text)
    if DIGIT.search(text):
        out += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
        out += [("ssn", *m.span()) for m in LOOSE_SSN.finditer(text)]
        out += [("iban", *m.span()) for m in LOOSE_IBAN.finditer(text)]
        out += [("ip", *m.span()) for m in IP.finditer(text)]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= m.end() - m.start() <= 40]
    if "(at)" in text or "[at]" in text:
        out += [("email", *m.span()) for m in LOOSE_EMAIL.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        out += [("secret", *m.span()) for m in ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        for m in SECRET_VALUE.finditer(text):
            if text[max(0, m.start() - 14):m.start()].rstrip().lower().endswith(SECRET_WORDS):
                out.append(("secret", *m.span(1)))
    if any(t in text for t in TITLES):
        out += [("name", *m.span(1)) for m in TITLED.finditer(text)]
    return list(dict.fromkeys(out))


def _strict(kind, span):
    digits = len(DIGIT.findall(span))
    if kind == "card":
        return 1 if 16 <= digits <= 19 else -1
    if kind == "phone":
        return 1 if span[0] == "+" else 0
    if kind == "email":
        return 1 if "@" in span else 0
    if kind == "secret":
        return 1 if ACCESS_KEY.fullmatch(span) and len(span) == 20 else 1 if digits and digits < len(span) else -1
    return 1


def _valid(kind, span):
    """Checksums and ranges; 0 where a kind has none."""
    plain = re.sub("[^0-9A-Za-z]", "", span)
    if kind == "card":
        return 1 if plain.isdigit() and luhn(plain) else -1
    if kind == "ip":
        return 1 if all(int(p[-4:]) <= 255 and len(p) <= 3 for p in span.split(".")) else -1
    if kind == "iban":
        return 1 if 15 <= len(plain) <= 34 and mod97(plain) else -1
    if kind == "ssn":
        return 1 if SSN.fullmatch(span) else -1
    if kind == "secret":
        return 1 if entropy(span) >= 2.75 and len(span) >= 8 else -1
    if kind == "phone":
        return 1 if 8 <= len(plain) <= 15 else -1
    return 0


def _listed(kind, span, before):
    if any(clue in before for clue in CLUES[kind]):
        return 1
    if kind == "email":
        return 1 if span.rsplit(".", 1)[-1].lower() in ENDINGS else 0
    return 0


def _edge(char, inner):
    """0 none, 1 space, 2 mark, 3 letter or digit."""
    return 0 if not char else 1 if char.isspace() else 3 if char.isalnum() or char in inner else 2


def described(text, kind, start, end):
    """Votes of the six labelers and the feature cell of a span."""
    span, before = text[start:end], text[max(0, start - 24):start].lower()
    around = text[max(0, start - 20):start] + text[end:end + 20]
    left, right = _edge(text[start - 1:start], "_"), _edge(text[end:end + 1], "_")
    listed, valid = _listed(kind, span, before), _valid(kind, span)
    crowded = len(DIGIT.findall(around)) > len(around) // 2 > 0
    votes = (_strict(kind, span), valid, listed, 1 if left < 3 else -1, 1 if right < 3 else -1, -1 if crowded else 0)
    digits = len(DIGIT.findall(span)) / len(span)
    cell = (KINDS.index(kind), min(3, len(span) // 10), min(2, int(digits * 3)), left, right, listed, valid + 1)
    return votes, cell


PRIOR = 2.0             # rows of a kind that the prior of a labeler's rates weighs
VOTES = list(product((-1, 0, 1), repeat=6))
CELL = (len(KINDS), 4, 3, 4, 4, 2, 3)


def _counts(docs, text):
    """n of each (kind, votes, cell) that occurs, over all texts."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            seen = Counter()
            for t in batch.column(at).to_pylist():
                for kind, start, end in proposals(t or ""):
                    votes, cell = described(t, kind, start, end)
                    seen[VOTES.index(votes), int(np.ravel_multi_index(cell, CELL))] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in seen], pa.int32()) for i in (0, 1)] + [pa.array(list(seen.values()), pa.int64())],
                names=["votes", "cell", "n"])

    counted = docs.mapInArrow(run, "votes int, cell int, n long").groupBy("votes", "cell").agg(F.sum("n").alias("n"))
    span = int(np.prod(CELL[1:]))
    return stored(counted.withColumn("kind", (F.col("cell") / span).cast("int")), "votes")


def in_base(kind, votes):
    """Rows that the base patterns find: of a base kind, in its strict form, and with no
    checksum or range against them."""
    return (kind < len(BASE)) & (votes[:, 0] == 1) & (votes[:, 1] >= 0)


def estimate(kind, votes, n, known=None, rounds=100):
    """Reliability of each labeler for each kind, and probability of each row, by EM.

    A labeler has two rates per kind: how often it votes for a span that is personal
    data, and how often against one that is not. Rows ``known`` to be personal data keep
    probability 1 and tell about the labelers, not about the share of personal data among
    the others. A labeler that never votes both ways in a kind tells nothing apart
    there and is left out (rates 0.5); where none is left, rows follow the plain majority.
    EM starts from the majority of the votes, each less its labeler's mean in the kind. A
    labeler's prior says that it votes alike on both sides and weighs ``PRIOR`` rows,
    whatever the kind's size: any labeler that guesses is found out. ``hit`` and ``miss``
    have a row per kind."""
    n, kind = np.asarray(n, float), np.asarray(kind)
    known = np.zeros(len(n), bool) if known is None else known
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    p = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1)
    hit, miss = np.full((2, len(KINDS), votes.shape[1]), 0.5)
    for k in np.unique(kind):
        at = kind == k
        y, v, m, sure = yes[at], no[at], n[at][:, None], known[at]
        p[at] = np.where(sure, 1.0, p[at])
        differ = (y.max(0) > 0) & (v.max(0) > 0)
        if not differ.any():
            continue
        y, v = y * differ, v * differ
        usual = np.where(differ, (y * m).sum(0) / np.maximum(((y + v) * m).sum(0), 1), 0.5)
        q = np.where(sure, 1.0, 1 / (1 + np.exp(-4 * (y * (1 - usual) - v * usual).sum(1))))
        for _ in range(rounds):
            on, off = q[:, None] * m, (1 - q)[:, None] * m
            hit[k] = ((y * on).sum(0) + usual * PRIOR) / (((y + v) * on).sum(0) + PRIOR)
            miss[k] = ((v * off).sum(0) + (1 - usual) * PRIOR) / (((y + v) * off).sum(0) + PRIOR)
            share = (on[~sure].sum() + 1) / (m[~sure].sum() + 2)
            odds = np.log(share / (1 - share)) + y @ np.log(hit[k] / (1 - miss[k])) + v @ np.log((1 - hit[k]) / miss[k])
            q = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
        p[at] = q
    return hit, miss, p


def features(cells):
    """One-hot columns of the cells' parts."""
    parts = np.unravel_index(cells, CELL)
    return np.concatenate([np.ones((len(cells), 1)), *[np.eye(size)[part] for part, size in zip(parts, CELL)]], 1)


def train(cells, n, positive, rounds=30, ridge=1.0):
    """Logistic weights by reweighted least squares on grouped counts."""
    x, n, positive = features(cells), np.asarray(n, float), np.asarray(positive, float)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (positive - n * p) - ridge * weights
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        weights = weights + np.linalg.solve(bend, slope)
    return weights


def fit(docs, text="text"):
    """Which cells are personal data, from the votes over all of ``docs``.

    The driver sees at most kinds x vote patterns rows (5,832), then one row per cell
    (at most 9,216)."""
    counts = _counts(docs, text)
    patterns = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").toPandas()
    if not len(patterns):
        return np.zeros(int(np.prod(CELL)), bool)
    kind, votes = patterns["kind"].to_numpy(), np.array([VOTES[v] for v in patterns["votes"]])
    _, _, p = estimate(kind, votes, patterns["n"], in_base(kind, votes))
    known = docs.sparkSession.createDataFrame(pd.DataFrame({"kind": patterns["kind"], "votes": patterns["votes"], "p": p}),
                                              "kind int, votes int, p double")
    cells = (counts.join(known, ["kind", "votes"]).groupBy("cell")
             .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("positive")).orderBy("cell").toPandas())
    weights = train(cells["cell"].to_numpy(), cells["n"], cells["positive"])
    return features(np.arange(int(np.prod(CELL)))) @ weights > 0


def found(text, accepted):
    """All spans of a text: the base ones, and proposals that the classifier accepts
    and that touch none found before. By kind as listed, then start."""
    base = base_spans(text)
    out, taken = list(base), [(s, e) for _, s, e in base]
    for kind, start, end in sorted(proposals(text), key=lambda s: (s[1], -s[2])):
        if all(end <= s or e <= start for s, e in taken):
            if accepted[int(np.ravel_multi_index(described(text, kind, start, end)[1], CELL))]:
                out.append((kind, start, end))
                taken.append((start, end))
    return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_data(docs):
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    A null or empty text has no spans (the digest is that of the empty string);
    repeated rows repeat their result; an empty table gives none."""
    plain = pick(docs, "doc_id", "text")
    accepted = fit(plain)

    def make(batch):
        rows = []
        for t in batch.column(1).to_pylist():
            base, spans = found(t or "", accepted)
            rows.append((*[sum(k == kind for k, _, _ in base) for kind in BASE],
                         hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        columns = list(zip(*rows)) or [()] * 6
        return [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)]

    return add_columns(plain, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").drop("text")


def redacted(docs):
    """The documents with every span replaced by its kind in angle brackets; a null
    text stays null, and ``n_chars`` follows the text where there is one."""
    plain, at = positions(docs, "text")
    accepted = fit(plain, at["text"])
    text_at = plain.columns.index(at["text"])

    def make(batch):
        out = []
        for t in batch.column(text_at).to_pylist():
            for kind, start, end in sorted(found(t, accepted)[1], key=lambda s: -s[1]) if t else ():
                t = f"{t[:start]}<{kind.upper()}>{t[end:]}"
            out.append(t)
        return [pa.array(out, pa.string())]

    cleaned = add_columns(plain, make, "cleaned string").withColumn(at["text"], F.col("cleaned"))
    if "n_chars" in docs.columns:
        n = plain.columns[docs.columns.index("n_chars")]
        cleaned = cleaned.withColumn(n, F.coalesce(F.length("cleaned").cast(plain.schema[n].dataType), F.col(n)))
    return cleaned.select(*plain.columns).toDF(*docs.columns)
