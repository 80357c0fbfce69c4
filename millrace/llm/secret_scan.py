"""Secret scan: three base patterns, and a character convolutional network over every candidate in its context.

Candidates are the base findings and all maximal runs of 16 or more characters of the secret alphabet, with or without digits. Of one over BODY
characters, windows that slide over the whole of it and its parts between separators are scored, and the highest score counts. The network (one-hot
character classes, 16 filters of width 5, maximum pooling over the candidate and over its context, a logistic layer)
is trained in numpy on labelled findings drawn from a generator of secrets and look-alikes. Its scores are calibrated
on a second part of these, and the threshold is the highest that keeps RECALL of the secrets of a third.
Base spans are always kept, with the probability that the network gives them; it adds spans (kind cnn) for the other candidates over the threshold, unless one
base span covers them. Offsets are code points, end exclusive.

Defined cases: null texts are empty; texts without findings have zero counts and the digest of the empty string;
repeated rows are scanned each; whole texts of any length are scanned; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
PART = re.compile(r"[A-Za-z0-9+=]{16,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "cnn")
BEFORE, BODY, AFTER = 20, 40, 12
LENGTH = BEFORE + BODY + AFTER
WIDTH, FILTERS = 5, 16
RECALL = 0.97
#: Groups of characters that count as one class each.
_GROUPS = [
    *"=:\"'@/.-_+ ", "\n\t\r",
    "ae", "bcdf", "iou", "lnrst", "ghmpwy", "jkqvxz",
    "AE", "BCDF", "IOU", "LNRST", "GHMPWY", "JKQVXZ",
    "01234", "56789", "(){}[]<>", ",;!?|&%$#*",
]
_CLASSES = {c: k + 1 for k, group in enumerate(_GROUPS) for c in group}
N_CLASSES = 2 + max(_CLASSES.values())
#: Class by code point; 0 stands for no character, and all beyond the table are the last class.
_TABLE = np.full(256, N_CLASSES - 1, np.int64)
_TABLE[[0, *map(ord, _CLASSES)]] = [0, *_CLASSES.values()]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of what is secret), in order."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        end = m.start() + len(m[0].rstrip(".=_-/+"))
        if end - m.start() >= 16:
            out.append((m.start(), end))
    return out


def window(text: str, start: int, end: int) -> str:
    """Context before, BODY characters of a candidate at most, context after; fixed length. Zero characters fill it up."""
    if end - start > BODY:
        raise ValueError("a window holds BODY characters")
    body = text[start:end].replace("\0", " ")
    before, after = text[max(0, start - BEFORE) : start].replace("\0", " "), text[end : end + AFTER].replace("\0", " ")
    return before.rjust(BEFORE, "\0") + body.ljust(BODY, "\0") + after.ljust(AFTER, "\0")


def windows_of(text: str, start: int, end: int) -> list[str]:
    """The windows of a candidate: one, or for a long one those of each BODY characters, half over the one before, and those of its parts between separators."""
    spots = [(start, end)]
    if end - start > BODY:
        parts = [(start + m.start(), start + m.end()) for m in PART.finditer(text[start:end])]
        spots = []
        for s, e in dict.fromkeys([(start, end), *parts]):
            spots += [(k, k + BODY) for k in range(s, e - BODY, BODY // 2)] + [(max(s, e - BODY), e)]
    return [window(text, s, e) for s, e in dict.fromkeys(spots)]


def encode(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, LENGTH)
    return np.where(points < 256, _TABLE[np.minimum(points, 255)], N_CLASSES - 1)


def labelled_findings(n: int = 6000, seed: int = 11) -> tuple[list[str], np.ndarray]:
    """Windows of secrets (1) and of look-alikes (0), in equal numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    run = lambda alphabet, lo, hi: "".join(alphabet[k] for k in rng.integers(0, len(alphabet), int(rng.integers(lo, hi + 1))))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    parts = (
        "sch ch ung ein lich keit eau que ment tion aux ble th er on an re he in ed nd ha "
        "at en es of or nt ea ti to it st io le is ou ar as de rt ve"
    ).split()
    word = lambda lo=1, hi=4: "".join(pick(parts) for _ in range(int(rng.integers(lo, hi + 1))))
    prose = lambda k: " ".join(word() for _ in range(k))
    secrets = [
        lambda: run(dig + "abcdef", 16, 64),
        lambda: run(dig + "ABCDEF", 20, 64),
        lambda: run(low + up + dig, 20, 44) + "7",
        lambda: run(low + up + dig + "+/", 24, 64) + "4=",
        lambda: pick(["ghp_", "gho_", "pk_live_", "rk_test_", "glpat-", "npm_", "hf_"]) + run(low + up + dig, 20, 36),
        lambda: "xoxb-" + run(dig, 10, 12) + "-" + run(low + up + dig, 20, 26),
        lambda: "eyJ" + run(low + up + dig, 20, 40) + "." + run(low + up + dig + "-_", 30, 60),
        lambda: pick(["AKIA", "ASIA"]) + run(up + dig, 14, 16),
        lambda: run(low + dig, 24, 40) + "0q",
        lambda: run(up + dig, 20, 32) + "2Z",
        lambda: run(low, 16, 24),
        lambda: run(low + up, 20, 44),
        lambda: run(low + up, 16, 20),
        lambda: run(up, 20, 32),
    ]
    plain = [
        lambda: word(2, 3) + "." + word(2, 3) + run(dig, 1, 4),
        lambda: run(dig, 16, 19),
        lambda: "-".join((run(dig, 4, 4), run(dig, 2, 2), run(dig, 2, 2))) + "T" + run(dig, 2, 2) + run(dig, 4, 4),
        lambda: "/".join([word(2, 4), word(2, 4), word(1, 3) + run(dig, 1, 3)]) + pick([".html", ".py", ".png", ""]),
        lambda: "_".join(word(1, 3) for _ in range(4)) + run(dig, 1, 2),
        lambda: word(7, 10) + run(dig, 1, 2),
        lambda: "".join(word(1, 2).title() for _ in range(5)) + run(dig, 1, 2),
        lambda: ".".join(run(dig, 1, 4) for _ in range(6)),
        lambda: "-".join(word(1, 3) for _ in range(4)) + "-" + run(dig, 2, 5),
        lambda: pick("=-_.") * 18 + run(dig, 1, 1),
        lambda: word(1, 2) * 6 + run(dig, 1, 2),
        lambda: "mail" + run(dig, 1, 3) + "." + word(3, 4) + ".example",
        lambda: run(dig, 3, 4) + "-" + run(dig, 3, 4) + "-" + run(dig, 4, 6) + "-" + run(dig, 4, 4),
        lambda: word(7, 11),
        lambda: word(7, 10).title() + ".",
        lambda: word(7, 10).upper(),
        lambda: "/".join(word(2, 4) for _ in range(5)),
        lambda: "-".join(word(2, 4) for _ in range(3)),
        lambda: "".join(word(2, 3).title() for _ in range(3)),
    ]
    plain_leads = [" ", "=", ": ", ' "', "'", "\n"]
    leads = [lambda: pick(plain_leads)] * len(plain_leads) + [lambda: pick(["key", "auth", "sig", "bearer", "client_id", "hash"]) + pick(["=", ": ", " = ", ' = "'])]
    windows, y = [], np.arange(n) % 2
    for k in y:
        body = (pick(secrets)() if k else pick(plain)())[:BODY]
        while len(body) < 16:
            body += pick(parts) if not k else pick(low)
        mail = not k and rng.random() < 0.2
        before = prose(4) + (pick(leads)() if k or not mail else pick([" ", " " + word() + "@"]))
        after = ("@" + word(2, 3) + ".com " if mail and "@" not in before else pick([" ", "\n", '" ', ", ", ". "])) + prose(3)
        if rng.random() < 0.15:  # a part of a longer run
            before, after = before + word(2, 4) + pick("/.=-_"), pick("/.=-_") + word(2, 4) + after
        text = before + body + after
        windows.append(window(text, len(before), len(before) + len(body)))
    return windows, y.astype(float)


def _columns(x: np.ndarray) -> np.ndarray:
    """(n, positions, WIDTH * N_CLASSES) of one-hot windows, as indices into a row of that width."""
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1) + np.arange(WIDTH) * N_CLASSES


def _pool(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the filters over body and context, and where they are."""
    a = w[_columns(x)].sum(2) + b  # (n, positions, FILTERS)
    spots = np.arange(a.shape[1])
    body = (spots >= BEFORE - 2) & (spots < BEFORE + BODY - 2)
    inner, outer = np.where(body[None, :, None], a, -1e9), np.where(body[None, :, None], -1e9, a)
    at = np.concatenate([inner.argmax(1), outer.argmax(1)], axis=1)
    top = np.concatenate([inner.max(1), outer.max(1)], axis=1)
    mean = np.maximum(np.where(body[None, :, None] & (x[:, 2 : 2 + a.shape[1], None] > 0), a, 0), 0).mean(1)
    return np.concatenate([np.maximum(top, 0), mean], axis=1), at


@lru_cache(maxsize=1)
def trained(epochs: int = 10, seed: int = 3) -> dict[str, np.ndarray]:
    windows, y = labelled_findings()
    x, rng = encode(windows), np.random.default_rng(seed)
    part = np.arange(len(y)) // 2 % 5  # as many secrets as look-alikes in each
    held, last = part == 3, part == 4
    w, b = rng.normal(0, 0.3, (WIDTH * N_CLASSES, FILTERS)), np.zeros(FILTERS)
    v, c = rng.normal(0, 0.1, 3 * FILTERS), np.zeros(1)
    params = [w, b, v, c]
    m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    fit = np.flatnonzero(part < 3)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for lo in range(0, len(order), 64):
            i = order[lo : lo + 64]
            h, at = _pool(x[i], w, b)
            d = (1 / (1 + np.exp(-(h @ v + c).clip(-30, 30))) - y[i]) / len(i)
            dh = np.outer(d, v)
            gw, gb = np.zeros_like(w), np.zeros_like(b)
            cols = _columns(x[i])
            for part in range(2):
                f = np.arange(part * FILTERS, (part + 1) * FILTERS)
                g = dh[:, f] * (h[:, f] > 0)
                rows = cols[np.arange(len(i))[:, None], at[:, f]]  # (n, FILTERS, WIDTH)
                np.add.at(gw, (rows, np.arange(FILTERS)[None, :, None]), g[:, :, None])
                gb += g.sum(0)
            t += 1
            for k, g in enumerate((gw, gb, h.T @ d + 1e-4 * v, np.array([d.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    raw, target = _pool(x[held], w, b)[0] @ v + c, y[held]
    a, o = 1.0, 0.0
    for _ in range(200):  # logistic calibration
        p = 1 / (1 + np.exp(-(a * raw + o).clip(-30, 30)))
        a, o = a - 0.02 * np.mean((p - target) * raw), o - 0.2 * np.mean(p - target)
    p = 1 / (1 + np.exp(-(a * (_pool(x[last], w, b)[0] @ v + c) + o).clip(-30, 30)))
    secrets = np.sort(p[y[last] == 1])
    return {"w": w, "b": b, "v": v, "c": c, "a": np.array([a, o]), "threshold": secrets[[int((1 - RECALL) * len(secrets))]]}


def probability(windows: list[str], net: dict[str, np.ndarray], piece: int = 256) -> np.ndarray:
    x, out = encode(windows), []
    for lo in range(0, len(x), piece):
        raw = _pool(x[lo : lo + piece], net["w"], net["b"])[0] @ net["v"] + net["c"]
        out.append(1 / (1 + np.exp(-(net["a"][0] * raw + net["a"][1]).clip(-30, 30))))
    return np.concatenate(out) if out else np.empty(0)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and findings: array of (kind, start, end, probability), by start and kind."""
    net = trained()
    sent = documents.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                asked, windows = [], []
                for n, text in enumerate(part["text"]):
                    base = base_spans(text)
                    spots = [(s, k, e, body) for s, k, e, body in base]
                    spots += [(s, 3, e, s) for s, e in candidates(text) if not any(bs <= s and e <= be for bs, _, be, _ in base)]
                    for s, k, e, body in spots:
                        own = windows_of(text, body, e)
                        asked.append((n, s, k, e, len(windows), len(windows) + len(own)))
                        windows += own
                scores, found = probability(windows, net), [[] for _ in range(len(part))]
                for n, s, k, e, lo_, hi_ in asked:
                    p = float(scores[lo_:hi_].max())
                    if k < 3 or p >= net["threshold"][0]:
                        found[n].append((s, k, e, p))
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "probability": p} for s, k, e, p in sorted(f)] for f in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "findings": spans})

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInPandas(run, "doc_id long, findings array<struct<kind:string,start:long,end:long,probability:double>>")


def secret_spans(documents: DataFrame) -> DataFrame:
    """The rows that op8 returns."""
    found = F.col("findings")
    told = lambda xs: F.array_join(F.transform(xs, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    n = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda f: f["kind"] != "cnn")
    return scan(documents).select("doc_id", n("assign"), n("access"), n("hex"), n("cnn"), F.sha2(told(base), 256).alias("base_sha256"), told(found).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
