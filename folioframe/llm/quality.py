"""Per-document text statistics, and the texts that are not natural prose.

Every text gets its statistics (word count, mean word length, symbol ratio,
share of lines ending in punctuation, share of common words) and the shares of
its characters that lie in table rows, list entries, unreadable and running
lines. A Gaussian mixture is fitted by expectation-maximisation on the
standardised statistics of all documents, its components are mapped to prose,
list, table or junk with the inspected examples below, and a document's kind is
the one its components give the largest probability.

Defined results: null and blank texts have counts of 0, null ratios and no
kind; statistics use whole texts; equal texts get equal kinds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.lexicon import common_words
from folioframe.plans.staging import spread, stage

KINDS = ("prose", "list", "table", "junk")

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NUMBER = re.compile(r"^[(<>~≈±+−–-]*\d[\d.,±%+−–/-]*\)?%?$|^[—–-]$|^n\.[sa]\.$|^n/a$", re.I)
_MARK = re.compile(r"^\s*(?:[-–—*•▪◦‣·▸►●○■□☐☑☒✓✗+>]|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\d{1,3}(?=\s+\S))\s*")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_RULE = re.compile(r"^[\W_]+$")
_HTML_ROW = re.compile(r"</?(?:tr|td|th|table|tbody|thead)\b", re.I)
_BROKEN = re.compile(r"[ÃÂ][\u0080-¿Œ-˜‘-™]|â€|[�￾￿-]|[\x00-\x08\x0e-\x1f\x7f]|[\u0080-\u009f]|&#?\w{2,6};|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}")
_BROKEN_ASCII = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]|&#?\w{2,6};|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}")
_NO_DIGIT = re.compile(r"\D+")
_DIGITS = re.compile(r"^\d{16,}$")
_LEADER = re.compile(r"\.{4,}|(?:\. ){4,}|…{2,}")
_HEX = re.compile(r"^(?:0x)?[0-9a-fA-F]{2}$|^(?:0x)?(?=.*\d)[0-9a-fA-F]{8,}$")


def _cells(line: str) -> tuple[str, list[str]]:
    """(separator, cells) by the strongest separator of a line; one cell if there is none."""
    s = line.strip()
    if s.count("|") >= 2 or (s.startswith("|") and s.endswith("|")):
        return "|", [c.strip() for c in s.strip("|").split("|")]
    if "\t" in s:
        return "t", [c.strip() for c in s.split("\t")]
    if s.count(" & ") >= 2 or (" & " in s and s.endswith("\\\\")):
        return "&", [c.strip() for c in s.removesuffix("\\\\").split("&")]
    if s.count(";") >= 2:
        return ";", [c.strip() for c in s.split(";")]
    wide = re.split(r"\s{2,}", s)
    if len(wide) >= 3:
        return "w", wide
    if s.count(",") >= 2 and not re.search(r",\s", s):
        return ",", s.split(",")
    if s.count(" / ") >= 2:
        return "/", s.split(" / ")
    return "", [s]


class _Memo(dict):
    """Values of short strings, each found once per task; looked up by ``map`` without a Python frame per string."""

    def __init__(self, find, most: int = 200_000):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        value = self.find(key)
        if len(key) <= 40:
            self[key] = value
        return value

    def total(self, keys: list[str], start=0):
        return sum(map(self.__getitem__, keys), start)


class Lookups:
    """What a task remembers of words and tokens."""

    def __init__(self, tri: dict[str, float] | None = None):
        def oddness(w: str) -> complex:
            # letters of the word, and again if the corpus hardly has half of its trigrams
            n = len(w)
            if n < 4 or not tri:
                return 0j
            return complex(n, n if sum(w[i : i + 3] in tri for i in range(n - 2)) < 0.5 * (n - 2) else 0)

        self.odd = _Memo(oddness)
        self.coded = _Memo(lambda t: len(t) if _is_coded(t) else 0)
        self.broken = _Memo(lambda t: _BROKEN.search(t) is not None)
        self.number = _Memo(lambda t: _NUMBER.match(t) is not None)

    def odd_share(self, words: list[str]) -> float:
        """Share of letters in words that look like no word of the corpus."""
        sums = self.odd.total(words, 0j)
        return sums.imag / sums.real if sums.real else 0.0


def _repetition(tokens: list[str]) -> float:
    """1 - distinct / all four-token runs: near 1 if one fragment is repeated over and over.

    Halved for long texts that come back to many phrases but to none of them often.
    """
    n = len(tokens)
    if n < 12:
        return 0.0
    grams = Counter(zip(tokens, tokens[1:], tokens[2:], tokens[3:]))
    share = 1 - len(grams) / (n - 3)
    return share if share > 0.85 or max(grams.values()) >= 0.04 * (n - 3) else share / 2


def statistics(
    text: str | None, common: frozenset[str], tri: dict[str, float] | None = None, known: Lookups | None = None
) -> dict[str, Any]:
    """The statistics of one whole text."""
    out: dict[str, Any] = dict.fromkeys(STATS, None)
    out |= {"n_words": 0, "n_lines": 0}
    if text is None or not (tokens := text.split()):
        return out
    lines = [x for x in (x.strip("﻿​ ") if not x.strip() else x for x in _LINE.split(text)) if x.strip()]
    solid = sum(map(len, tokens))
    if not solid or not lines:
        return out
    known = known or Lookups(tri)
    words_of = [_WORD.findall(x) for x in map(str.lower, lines)]
    words = [w for ws in words_of for w in ws]
    letters = sum(map(len, words))
    digits = len(_NO_DIGIT.sub("", text))
    led = solid
    if ".." in text or "…" in text or ". ." in text:
        led -= sum(len(x.group().replace(" ", "")) - 1 for x in _LEADER.finditer(text))  # leader dots count once
    out["n_words"], out["n_lines"] = len(tokens), len(lines)
    out["mean_word_len"] = solid / len(tokens)
    out["symbol_ratio"] = max(0.0, (led - letters - digits) / max(1, led))
    out["digit_ratio"] = digits / solid
    out["end_punct"] = sum(_END.search(x.rstrip()[-12:]) is not None for x in lines) / len(lines)
    hits_of = [sum(map(common.__contains__, ws)) for ws in words_of]
    out["common"] = sum(hits_of) / len(words) if words else 0.0
    out["repetition"] = _repetition(tokens)
    out["odd"] = known.odd_share(words)
    out["broken"] = known.broken.total(tokens) / len(tokens) if (_BROKEN_ASCII if text.isascii() else _BROKEN).search(text) else 0.0
    out["coded"] = known.coded.total(tokens) / solid
    out |= _line_shares(lines, words_of, hits_of, common, known)
    return out


def _is_coded(token: str) -> bool:
    """Hexadecimal pairs, long digit runs and long blobs."""
    if _HEX.match(token) or _DIGITS.match(token):
        return True
    return len(token) > 30 and not _BROKEN.search(token) and "///" not in token and _blob(token)


def _blob(token: str) -> bool:
    """A long token that is no word: mixed case, digits and signs, or digits only."""
    core = token.strip(".,;:!?()[]\"'")
    if len(re.findall(r"[,;|]", core)) > 1 or "<" in core:
        return False
    classes = sum(bool(re.search(p, core)) for p in ("[a-z]", "[A-Z]", r"\d", r"[+/=_-]"))
    return classes >= 3 or core.isdigit() or bool(re.fullmatch(r"[0-9a-fA-F]{24,}", core))


def _line_shares(
    lines: list[str], words_of: list[list[str]], hits_of: list[int], common: frozenset[str], known: Lookups
) -> dict[str, float]:
    """Shares of the characters in table rows, list entries, noise and running lines."""
    cut = [_cells(x) for x in lines]
    number = known.number
    kind: list[str] = []
    for i, (line, words, hits, (sep, cells)) in enumerate(zip(lines, words_of, hits_of, cut)):
        s = line.strip()
        if "<" in s and _HTML_ROW.search(s):
            kind.append("table")
        elif words and (".." in s or "…" in s or ". ." in s) and _LEADER.search(s):
            kind.append("entry")
        elif not words and _RULE.match(s):
            kind.append("rule" if len(set(s) - {" "}) <= 4 else "noise")
        elif len(cells) >= 3 and sep in ("|", "t", "&", "w"):
            lone = sep in ("w",) and number.total(cells) == 0 and len(words) > 10
            kind.append("flow" if lone else "table")
        elif len(cells) >= 3 and sep in (";", ",", "/"):
            around = [len(cut[j][1]) for j in (i - 1, i + 1) if 0 <= j < len(cut) and cut[j][0] == sep]
            same = any(abs(n - len(cells)) <= 1 for n in around)
            short = sum(len(c) for c in cells) / len(cells) <= 24
            if same and short and hits < 0.25 * max(1, len(words)):
                kind.append("table")
            elif short and hits < 0.2 * max(1, len(words)):
                kind.append("entry")
            else:
                kind.append("flow")
        else:
            toks = s.split()
            numeric = number.total(toks)
            if len(toks) >= 3 and numeric >= 2 and numeric >= len(toks) - 2 and not _MARK.match(s):
                kind.append("table")
            elif len(toks) >= 2 and numeric >= 1 and len(toks) <= 6 and _loose_row(lines, i) and not _END.search(s[-12:]):
                kind.append("table")
            elif 5 * (sum(map(len, words)) + len(_NO_DIGIT.sub("", s))) < 2 * sum(map(len, toks)) and not _MARK.match(s):
                kind.append("noise")  # mostly signs, with or without single letters
            else:
                kind.append("text")
    # text lines: entries or running text, by block
    weight = [sum(map(len, x.split())) for x in lines]
    share = Counter()
    n_text = n_common = 0
    text_lines = []
    for k, line, words, found, w in zip(kind, lines, words_of, hits_of, weight):
        if k in ("text", "flow"):
            mark = _MARK.match(line) if k == "text" else None
            bare = line[mark.end() :] if mark else line
            ws, hits = words, found
            if mark:
                ws = _WORD.findall(bare.lower())
                hits = sum(map(common.__contains__, ws))
            text_lines.append((bare, len(ws), hits, w))
            n_text, n_common = n_text + len(ws), n_common + hits
        elif k != "rule":
            share["table" if k == "table" else "entry" if k == "entry" else "noise"] += w
    if any(k == "table" for k in kind):
        share["table"] += sum(w for k, w in zip(kind, weight) if k == "rule")
    else:
        share["noise"] += sum(w for k, w in zip(kind, weight) if k == "rule")
    whole = n_common / n_text if n_text else 0.0
    for i, (bare, n_words, hits, w) in enumerate(text_lines):
        near = text_lines[max(0, i - 1) : i + 2]
        around = sum(t[1] for t in near)
        own = hits / n_words if n_words else 0.0
        local = max(own, min(whole, sum(t[2] for t in near) / around if around else 0.0))
        ended = bool(_END.search(bare.rstrip()[-12:]))
        items = bare.count(", ") + 1
        if items >= 4 and not ended and own < 0.3 and n_words <= 3 * items:
            running = False
        elif whole >= 0.15:
            running = (n_words >= 5 and (local >= 0.2 or (local >= 0.12 and ended))) or (local >= 0.24 and n_text >= 5)
        else:  # mostly entries: a sentence must show by itself
            running = n_words >= 8 and own >= 0.25
        share["flow" if running else "entry"] += w
    total = sum(share.values()) or 1
    return {
        "s_table": share["table"] / total, "s_list": share["entry"] / total,
        "s_noise": share["noise"] / total, "s_flow": share["flow"] / total,
    }


def _loose_row(lines: list[str], i: int) -> bool:
    """Short rows parted by single blanks: the neighbours have as many tokens and end in numbers, too."""
    n = len(lines[i].split())
    if n < 3 or not _NUMBER.match(lines[i].split()[-1]):
        return False
    near = [lines[j].split() for j in (i - 1, i + 1) if 0 <= j < len(lines)]
    return any(len(x) == n and _NUMBER.match(x[-1]) for x in near)


STATS = [
    "n_words", "n_lines", "mean_word_len", "symbol_ratio", "digit_ratio", "end_punct", "common", "repetition",
    "odd", "broken", "coded", "s_table", "s_list", "s_noise", "s_flow",
]


#: Statistics that tell how large a text is.
SIZES = ("n_words", "n_lines", "mean_word_len")

#: Inspected examples: what each kind looks like. Components of the mixture start at them and are named by them.
EXAMPLES: tuple[tuple[str, str], ...] = (
    ("prose", "The pump was replaced in the spring because it had lost pressure. After that the flow was stable again, and nobody saw a second fault."),
    ("prose", "In the second run we measured the flow\nof the pump at three points and found that\nit was lower than in the report, although\nnothing else had been changed. The reason\nis not known."),
    ("prose", "Der Wert wurde am dritten Tag gemessen und ist nicht so hoch wie im Bericht. Warum das so ist, wird auf der letzten Seite erklärt."),
    ("prose", "La valeur est plus basse que dans le rapport, mais la raison n'est pas donnée.\nOn peut la trouver dans l'annexe, qui a été ajoutée plus tard."),
    ("prose", "en la tabla se ve que el valor de la bomba es menor que el del informe y que no cambia con el tiempo"),
    ("list", "- pump\n- valve (mm)\n- pressure gauge\n- hose\n- second filter\n- seal"),
    ("list", "Pump: 12 kPa\nValve: 3.5 mm\nHose: 40 cm\nFilter: 7 %\nSeal: 2 mm"),
    ("list", "pump; valve; pressure gauge; hose; second filter; seal; thermal sensor; housing"),
    ("list", "[1] Miller, Stone. Pump design, 1999, pp. 10-22.\n[2] Weaver, Hill. Valve, 2004, pp. 3-9.\n[3] Baker. Flow sensor, 2011, pp. 100-118."),
    ("table", "Part | Pressure | Flow\n--- | --- | ---\nPump | 12.5 | 340\nValve | 7.1 | 80\nHose | n.s. | 95"),
    ("table", "Part\tPressure\tFlow\tLoss\nPump\t12.5\t340\t1.2\nValve\t7.1\t80\t0.4\nHose\t3.0\t95\t0.1"),
    ("table", "Pump 12.5 340 1.2\nValve 7.1 80 0.4\nHose 3.0 95 0.1\nSeal 1.1 20 0.3"),
    ("table", "<tr><td>Part</td><td>Pressure</td><td>Flow</td></tr>\n<tr><td>Pump</td><td>12.5</td><td>340</td></tr>"),
    ("junk", "3f a0 77 1c 9e 04 b2 55 d8 61 0f ee 92 4a 7b c3 18 d5 60 2e 81 fa 39 6c"),
    ("junk", "kJ8sQz0PaX9vLm3RtY7uWd2BnC5eFh1GiK4oNq6TsUwVyZxAbDcEfHgIjMlOpQrSt8u9v0w1x2y3z4=="),
    ("junk", "@@#%&*+=~^|<>{}[]$$§§##@@%%&&**++==~~^^||<<>>@#%&*"),
    ("junk", "□¤þ£€£þ?ð??□ð€þ¤?þð□□€ßß??■ßþ□¿£€ß□ð£ð■□ßßß□□■□£€þ¤¿ ????? ???????? ???? ???? ?????? ???????? ????"),
    ("junk", "pump 12 kPa pump 12 kPa pump 12 kPa pump 12 kPa pump 12 kPa pump 12 kPa pump 12 kPa pump 12 kPa"),
    ("junk", "ThÃ¤ pÃ¼mÃ©p wÃ¨s rÃ¶plÃ¤cÃ©d Ã¤n thÃ¼ sprÃ¨ng bÃ©cÃ¤usÃ¼ iÃ¶ hÃ¤d lÃ¼st prÃ¨ssÃ©re"),
    ("junk", "eTh mppu swa eplcrdea ni hte gnrpsi uesbcea ti dha tols rspesuer dna ydbonoo wsa a cosdne utlfa"),
)

#: Letter trigrams rarer than this in the corpus count as unknown; at most 1 / RARE trigrams are kept.
RARE = 3e-5
#: Shares that speak for a kind by their majority, with the place of their turning point; steepness of the turn.
TURNS = {"s_table": 0.5, "s_list": 0.5, "s_noise": 0.5, "s_flow": 0.5, "broken": 0.5, "coded": 0.5, "repetition": 0.45, "odd": 0.4}
STEEPNESS = 10.0
#: Least variance of a component.
FLOOR = 0.05
def trigram_shares(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Letter trigrams that make up at least RARE of the corpus (so a bounded number), from all texts."""

    def run(batches):
        import pandas as pd

        seen: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for text in b["text"]:
                words.update(_WORD.findall(text.lower()))
            for w, n in words.items():
                for i in range(len(w) - 2 if len(w) >= 4 else 0):
                    seen[w[i : i + 3]] += n
            if len(seen) > 200_000:
                yield pd.DataFrame({"tri": list(seen), "n": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"tri": pd.Series(list(seen), dtype="object"), "n": pd.Series(list(seen.values()), dtype="int64")})

    counted = spread(docs.select(F.col(text_col).alias("text")).filter("text is not null")).mapInPandas(run, "tri string, n bigint")
    sums = stage(counted.groupBy("tri").agg(F.sum("n").alias("n")), "trigrams")
    total = sums.agg(F.sum("n")).first()[0] or 0
    return {r["tri"]: 1.0 for r in sums.filter(F.col("n") >= max(1, total * RARE)).select("tri").toLocalIterator()}


def text_statistics(docs: DataFrame, common: frozenset[str], tri: dict[str, float]) -> DataFrame:
    """doc_id and STATS of every document."""

    def run(batches):
        import pandas as pd

        known = Lookups(tri)
        for b in batches:
            rows = [statistics(t, common, tri, known) for t in b["text"]]
            out = {"doc_id": b["doc_id"]}
            out |= {k: pd.Series([r[k] for r in rows], dtype="float64", index=b.index) for k in STATS}
            yield pd.DataFrame(out)

    schema = "doc_id bigint, " + ", ".join(f"{k} double" for k in STATS)
    return spread(docs.select("doc_id", "text")).mapInPandas(run, schema)


def common_set(words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages in lower case."""
    return frozenset(word for _, word in common_words(words))


def _vector(stats, np):
    """Rows of features: sizes on a log scale, majorities turned to nearly 0 or 1, other shares as they are."""
    x = np.nan_to_num(np.asarray(stats, dtype="float64"))
    for i, k in enumerate(STATS):
        if k in SIZES:
            x[:, i] = np.log1p(x[:, i])
        elif k in TURNS:
            x[:, i] = 1 / (1 + np.exp(-STEEPNESS * (x[:, i] - TURNS[k])))
    return x


def _feature(k: str) -> Column:
    """The same in the JVM."""
    c = F.coalesce(k, F.lit(0.0))
    if k in SIZES:
        return F.log1p(c)
    return 1 / (1 + F.exp(-STEEPNESS * (c - TURNS[k]))) if k in TURNS else c


def _inspected(common: frozenset[str], np):
    """Features of the inspected examples. The corpus' trigrams need not know their words, so ``odd`` is set by hand."""
    rows = [statistics(t, common, None) | {"odd": 0.8 if (k, t) == EXAMPLES[-1] else 0.0} for k, t in EXAMPLES]
    return _vector([[r[k] for k in STATS] for r in rows], np)


def _posterior(x, model, np):
    weight, mean, var = model
    d = x[:, None, :] - mean[None, :, :]
    logp = np.log(weight) - 0.5 * (np.log(2 * math.pi * var).sum(1) + (d * d / var).sum(2))
    top = logp.max(1, keepdims=True)
    p = np.exp(logp - top)
    return p / p.sum(1, keepdims=True), (top[:, 0] + np.log(p.sum(1))).sum()


class Mixture(NamedTuple):
    centre: Any
    scale: Any
    model: tuple  # weights, means, variances
    kinds: list[str]
    rounds: int
    log_likelihood: float
    converged: bool


def fit_mixture(stats: DataFrame, common: frozenset[str], rounds: int = 40, tolerance: float = 2e-3) -> Mixture | None:
    """A diagonal Gaussian mixture over all documents, one component per inspected example; None without any text.

    One pass over the statistics per round; a task sends its sums only, the
    driver gets components x features numbers. A component keeps the kind of
    the example nearest to its mean.
    """
    import numpy as np

    alive = stats.filter("n_words > 0")
    got = alive.agg(
        F.count("*").alias("n"), *[F.avg(_feature(k)).alias(f"a_{k}") for k in STATS], *[F.var_pop(_feature(k)).alias(f"v_{k}") for k in STATS]
    ).first()
    if not got["n"]:
        return None
    shown = _inspected(common, np)
    # the examples count as documents, so that a table of few texts has a scale
    n, m, k = got["n"], np.array([got[f"a_{c}"] for c in STATS]), len(shown)
    centre = (n * m + shown.sum(0)) / (n + k)
    spread = n * (np.array([got[f"v_{c}"] for c in STATS]) + (m - centre) ** 2) + ((shown - centre) ** 2).sum(0)
    scale = np.maximum(np.sqrt(spread / (n + k)), 1e-2)
    seeds = (shown - centre) / scale
    named = seeds.copy()
    # sizes of a text tell nothing about its kind: every component starts at the usual size
    seeds[:, STATS.index("n_words")] = 0.0
    model = (np.full(k, 1 / k), seeds.copy(), np.ones_like(seeds))
    before, ll, used = None, 0.0, 0
    for used in range(1, rounds + 1):

        def run(batches, model=model):
            import numpy as np
            import pandas as pd

            k, d = model[1].shape
            n, s1, s2, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0
            for b in batches:
                if len(b):
                    x = (_vector(b[STATS].to_numpy(), np) - centre) / scale
                    r, l = _posterior(x, model, np)
                    n, s1, s2, ll = n + r.sum(0), s1 + r.T @ x, s2 + r.T @ (x * x), ll + l
            kk, dd = np.meshgrid(np.arange(k), np.arange(d), indexing="ij")
            yield pd.DataFrame(
                {"k": kk.ravel(), "d": dd.ravel(), "n": np.repeat(n, d), "s1": s1.ravel(), "s2": s2.ravel(), "ll": ll}
            )

        parts = alive.select(*STATS).mapInPandas(run, "k int, d int, n double, s1 double, s2 double, ll double")
        sums = parts.groupBy("k", "d").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "ll")]).collect()
        n, s1, s2 = (np.zeros(seeds.shape) for _ in range(3))
        for r in sums:
            n[r["k"], r["d"]], s1[r["k"], r["d"]], s2[r["k"], r["d"]] = r["n"], r["s1"], r["s2"]
        # a component keeps one pseudo document at its example
        mass = n + 1.0
        mean = (s1 + seeds) / mass
        var = np.maximum((s2 + seeds**2 + 1.0) / mass - mean**2, FLOOR)
        model = (mass[:, 0] / mass[:, 0].sum(), mean, var)
        before, ll = ll if used > 1 else None, sums[0]["ll"]
        if before is not None and abs(ll - before) <= tolerance * abs(before):
            break
    use = [i for i, c in enumerate(STATS) if c not in SIZES]
    near = ((model[1][:, None, use] - named[None, :, use]) ** 2).sum(2).argmin(1)
    converged = before is not None and abs(ll - before) <= tolerance * abs(before)
    return Mixture(centre, scale, model, [EXAMPLES[i][0] for i in near], used, ll, converged)


def judged_documents(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, Mixture | None]:
    """doc_id, STATS, kind and its probability p of every document with text, and the mixture that gave them."""
    common = common_set(words)
    stats = stage(text_statistics(docs, common, trigram_shares(docs)), "text-statistics")
    fitted = fit_mixture(stats, common)
    schema = "doc_id bigint, " + ", ".join(f"{k} double" for k in STATS) + ", kind string, p double"
    if fitted is None:
        return docs.sparkSession.createDataFrame([], schema), None

    def run(batches):
        import numpy as np

        of = np.array([[kind == k for k in KINDS] for kind in fitted.kinds], dtype="float64")
        for b in batches:
            if len(b):
                x = (_vector(b[STATS].to_numpy(), np) - fitted.centre) / fitted.scale
                p = _posterior(x, fitted.model, np)[0] @ of
                yield b.assign(kind=[KINDS[i] for i in p.argmax(1)], p=p.max(1))

    return stats.filter("n_words > 0").mapInPandas(run, schema), fitted


def mixture_components(docs: DataFrame, words: DataFrame) -> DataFrame:
    """One row per component: its kind, its weight, and how the fit ended (rounds, log-likelihood, converged)."""
    common = common_set(words)
    m = fit_mixture(stage(text_statistics(docs, common, trigram_shares(docs)), "text-statistics"), common)
    rows = [] if m is None else [(i, k, float(w), m.rounds, float(m.log_likelihood), m.converged) for i, (k, w) in enumerate(zip(m.kinds, m.model[0]))]
    return docs.sparkSession.createDataFrame(rows, "component int, kind string, weight double, rounds int, log_likelihood double, converged boolean")


def not_prose(docs: DataFrame, words: DataFrame) -> DataFrame:
    return judged_documents(docs, words)[0].filter("kind <> 'prose'").select("doc_id", "kind").distinct()
