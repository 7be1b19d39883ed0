"""Personal data and secrets found by a semi-Markov conditional random field.

Candidate segments are spans of up to MAX_TOKENS tokens of any length, and unbroken runs of the
characters of keys that look like one, of any number of tokens, which are candidates as wholes only; a span is scored as a whole (its shape,
check sums, separators, what touches it and the words before it) for each type, every other token
stands alone as "other", and a dynamic programme over the segments finds the division with the
largest sum, so that boundaries and types are chosen together. Weights are fitted by maximum
likelihood, forward and backward over all divisions, on sequences that a seeded generator writes
from public formats, with decoys such as versions, dates and amounts.

Only spans with a digit, an @ or a run of LETTERS letters can be entities: names, addresses and short
passwords in plain words aren't among the types. A span passes a space only between groups of
digits or of up to 4 capitals. Text that no such span reaches is "other" under any weights, so that
the programme may skip from one stretch that spans can reach to the next without changing its
result; whole texts are covered, however long.

Defined results: a null or empty text has no entities; rows with a null id are kept with that id;
repeated rows give repeated results; of divisions with equal sums the one with fewer and earlier ended
segments is taken; an empty table gives an empty result; other columns are ignored. Offsets count
characters.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS, LETTERS, SEQUENCES, STEPS = 16, 24, 300, 60
KINDS = ["EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID"]

_TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]")
_HOT_TEXT = rf"[0-9@]|(?<![A-Za-z])[A-Za-z]{{{LETTERS}}}"
_HOT = re.compile(_HOT_TEXT)
_RUN = re.compile(r"[A-Za-z0-9_+/~-][A-Za-z0-9_+/.~-]{14,}[A-Za-z0-9_+/~-]={0,2}")
_SPACE = re.compile(r"\s")
_EMAIL = re.compile(r"[^\W_][\w.+%-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_QUAD = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_DOTTED = re.compile(r"\d+(?:\.\d+)+")
_PHONE = re.compile(r"\+?\d{0,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}")
_GROUPS = re.compile(r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}")
_HEX = re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}")
_KEYED = re.compile(r"[A-Z]{4}[A-Z0-9]{12,20}|(?:sk|pk|gh[a-z]|xox[a-z])[_-][A-Za-z0-9_-]{12,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_IBAN_WHOLE = re.compile(_IBAN.pattern + r"(?![^\W_])")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")
_SECRET_WORD = re.compile(r"(?:token|key|secret|passw\w*|auth\w*|bearer|credential\w*)\W{0,5}$", re.I)
_PHONE_WORD = re.compile(r"(?:tel\w*|phone|mobile|call|fax)\W{0,4}$", re.I)
_OPEN, _CLOSE, _GAP = set("+("), set(")"), {" ", " "}
_CHUNK = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


_NAMES = """other bias email at spaces digits0 digits3 digits6 digits8 digits12 digits19 digits20 all_digits quad quad_ok dotted phone
phone_plus parens unbalanced card_groups card_plain luhn hex keyed mixed long entropy secret_word phone_word glued_left glued_right
one few many lone_punct ssn iban iban_part date letters key_run""".split()
_AT = {name: i for i, name in enumerate(_NAMES)}


def _key_like(s: str) -> bool:
    """Nearly all letters and digits, with capitals, small letters and digits among them, unlike
    paths and addresses of pages."""
    return sum(map(str.isalnum, s)) >= 0.9 * len(s) and all(re.search(c, s) for c in ("[0-9]", "[A-Z]", "[a-z]"))


def features(text: str, start: int, stop: int, tokens: int) -> list[int]:
    """Indices of the features of the span."""
    s = text[start:stop]
    digits = [c for c in s if c.isdigit()]
    n, size = len(digits), len(s)
    on = ["bias", "one" if tokens == 1 else "few" if tokens < 5 else "many"]
    if "@" in s:
        on.append("at")
        if _EMAIL.fullmatch(s):
            on.append("email")
    if " " in s:
        on.append("spaces")
    on.append("digits0" if n == 0 else "digits3" if n < 4 else "digits6" if n < 7 else "digits8" if n < 9 else "digits12" if n < 13 else "digits19" if n < 20 else "digits20")
    if n == size:
        on.append("all_digits")
        if 13 <= n <= 19:
            on.append("card_plain")
    elif m := _QUAD.fullmatch(s):
        on.append("quad")
        if all(int(x) < 256 for x in m.groups()):
            on.append("quad_ok")
    elif _DOTTED.fullmatch(s):
        on.append("dotted")
    if _GROUPS.fullmatch(s):
        on.append("card_groups")
    if 13 <= n <= 19 and n >= 0.75 * size and _luhn("".join(digits)):
        on.append("luhn")
    if 8 <= n <= 14 and n < size and _PHONE.fullmatch(s) and not _DATE.fullmatch(s):
        on.append("phone")
        if s[0] == "+":
            on.append("phone_plus")
    if "(" in s or ")" in s:
        on.append("parens" if s.count("(") == s.count(")") else "unbalanced")
    if n < size and (n or size >= LETTERS) and " " not in s and "@" not in s:
        letters = sum(map(str.isalpha, s))
        if letters:
            on.append("letters")
            if size >= 16 and letters + n >= 0.85 * size:
                on.append("mixed")
            if _HEX.fullmatch(s):
                on.append("hex")
            if _KEYED.fullmatch(s):
                on.append("keyed")
            if size >= LETTERS and _RUN.fullmatch(s) and _key_like(s):
                on.append("key_run")
            if size >= 16 and -sum(p * log2(p) for p in (s.count(c) / size for c in set(s))) > 3:
                on.append("entropy")
    if size >= 24:
        on.append("long")
    if _SSN.fullmatch(s):
        on.append("ssn")
    if size >= 15 and _IBAN.fullmatch(s):
        whole = _IBAN_WHOLE.match(text, start)
        on.append("iban_part" if whole and whole.end() > stop else "iban")
    if _DATE.fullmatch(s):
        on.append("date")
    before = text[max(0, start - 24) : start]
    if _SECRET_WORD.search(before):
        on.append("secret_word")
    if _PHONE_WORD.search(before):
        on.append("phone_word")
    if before and (before[-1].isalnum() or before[-1] in "@_+-" or (before[-1] in "./" and len(before) > 1 and before[-2].isalnum())):
        on.append("glued_left")
    after = text[stop : stop + 2]
    if after and (after[0].isalnum() or after[0] in "@_" or (after[0] in ".-+/=" and len(after) > 1 and after[1].isalnum())):
        on.append("glued_right")
    return [_AT[x] for x in on]


def other(token: str) -> list[int]:
    """A token that stands alone outside all entities."""
    return [_AT["other"]]


def _group(token: str) -> bool:
    """Whether an entity with spaces may hold the token."""
    return token.isdigit() or (len(token) == 1 and token in "+()-./") or (len(token) <= 4 and (token.isupper() or (token.isalnum() and token.upper() == token)))


def _key_runs(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that look like keys and have several tokens, of any number."""
    if len(tokens) < 2:
        return []
    out, starts, ends = [], {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    for m in _RUN.finditer(text, tokens[0][0], tokens[-1][1]):
        i, j = starts.get(m.start()), ends.get(m.end())
        if i is not None and j is not None and j - i > 1 and len(m.group()) >= LETTERS and _key_like(m.group()):
            out.append((i, j))
    return out


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate spans: first token and the one behind the last."""
    out = _key_runs(text, tokens)
    inside = [False] * len(tokens)  # such a run is one candidate, its parts are none
    for i, j in out:
        inside[i:j] = [True] * (j - i)
    hot = [bool(_HOT.search(text, a, b)) for a, b in tokens]
    groups = [_group(text[a:b]) for a, b in tokens]
    alnum = [text[a].isalnum() for a, b in tokens]
    for i, (start, _) in enumerate(tokens):
        if inside[i] or (not alnum[i] and text[start] not in _OPEN):
            continue
        any_hot, gap, numeric = False, False, True
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, b = tokens[j]
            if inside[j]:
                break
            if j > i and a != tokens[j - 1][1]:
                if text[tokens[j - 1][1] : a] not in _GAP:
                    break
                gap = True
            numeric = numeric and groups[j]
            if gap and not numeric:
                break
            any_hot = any_hot or hot[j]
            if any_hot and (alnum[j] or text[a] in _CLOSE):
                out.append((i, j + 1))
    return out


def _generate(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with its entities."""
    low, up, hexa = string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef"
    word = lambda: "".join(rng.choice(low) for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))

    def card():
        body = num(15)
        digits = next(body + c for c in string.digits if _luhn(body + c)) if rng.random() < 0.5 else body + num(1)
        return digits if rng.random() < 0.6 else rng.choice(" -").join(digits[i : i + 4] for i in range(0, 16, 4))

    make = {
        "EMAIL": lambda: rng.choice([word(), f"{word()}.{num(2)}", f"{word()}.{word()}", f"{word()}_{word()}", word() + num(3)]) + "@" + rng.choice([word(), f"mail{num(1)}.{word()}", f"{word()}-{word()}"]) + "." + rng.choice(["com", "org", "net", "de", "co.uk"]),
        "PHONE": lambda: rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{num(2)} {num(2)} {num(4)} {num(4)}"]),
        "IP": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "CARD": card,
        "SECRET": lambda: rng.choice([pick(hexa, 40), pick(hexa, 32), pick(hexa, 64), pick(hexa, 40).upper(), "AKIA" + pick(up + string.digits, 15) + num(1), "sk_live_" + pick(low + string.digits, 20) + num(2), "ghp_" + pick(low + up + string.digits, 34) + num(2), pick(hexa, 96) + num(32), pick(low + up, rng.randint(28, 48)), f"eyJ{pick(low + up + string.digits, 24)}.eyJ{pick(low + up + string.digits, 40)}.{pick(low + up + string.digits, 30)}", pick(low + up + string.digits, 43) + "1",
            f"{pick(low + up + string.digits, 20)}{rng.choice('+/-_')}{pick(low + up + string.digits, 15)}{rng.choice('+/-_')}{pick(low + up + string.digits, 25)}{num(1)}", "".join(pick(low + up + string.digits, rng.randint(6, 14)) + rng.choice("+/-_") for _ in range(rng.randint(3, 6))) + pick(low, 4) + pick(up, 4) + num(2)]),
        "ID": lambda: rng.choice([f"{num(3)}-{num(2)}-{num(4)}", f"{pick(up, 2)}{num(20)}", f"{pick(up, 2)}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"{pick(up, 2)}{num(2)} {pick(up, 4)} {' '.join(num(4) for _ in range(rng.randint(2, 4)))} {num(2)}"]),
    }
    decoys = [
        lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: num(rng.randint(1, 9)), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"${num(3)}.{num(2)}",
        lambda: word() + num(2), lambda: f"{num(2)}:{num(2)}", lambda: f"@{word()}", lambda: f"{num(2)}%", lambda: f"v{num(1)}.{num(1)}.{num(1)}", lambda: f"1{num(1)}.0{num(1)}.19{num(2)}",
        lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{num(3)}.{num(3)}", lambda: pick(hexa, 8), lambda: f"{num(1)}.", lambda: f"{pick(up, rng.randint(2, 4))} {num(rng.randint(1, 4))}", lambda: f"{num(3)}/{num(4)}",
        lambda: f"https://{word()}.org/{word()}/{num(4)}/{word()}-{word()}-{word()}.html", lambda: "-".join(word() for _ in range(rng.randint(2, 5))) + num(1),
    ]
    text, found = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(0, 2)))
        if rng.random() < 0.35:
            text += " " + rng.choice(decoys)() + rng.choice(["", ".", ","])
        if rng.random() < 0.75:
            kind = rng.choice(KINDS)
            lead = " "
            if kind == "SECRET" and rng.random() < 0.5:
                lead = " " + rng.choice(['token = "', "api_key=", "secret: ", "TOKEN = \""])
            elif kind == "PHONE" and rng.random() < 0.3:
                lead = " tel: "
            text += lead
            value = make[kind]()
            found.append((len(text), len(text) + len(value), kind))
            text += value + ('"' if lead.endswith('"') else rng.choice(["", "", ".", ",", "!!", "###", "$$$", "***", "%%%", ")"]))
        text += " "
    return text, found


@lru_cache(maxsize=4)
def train(sequences: int = SEQUENCES, steps: int = STEPS, seed: int = 7, penalty: float = 1e-3) -> np.ndarray:
    """Weights of (OTHER, *KINDS) by features, by maximum conditional likelihood."""
    rng = random.Random(seed)
    data = []
    for _ in range(sequences):
        text, gold = _generate(rng)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        where = {s: i for i, (s, _) in enumerate(tokens)}
        ends = {e: i + 1 for i, (_, e) in enumerate(tokens)}
        entities = {(where[s], ends[e]): 1 + KINDS.index(k) for s, e, k in gold if s in where and e in ends and ends[e] - where[s] <= MAX_TOKENS}
        data.append((text, tokens, entities))
    longest = max(len(t) for _, t, _ in data)
    rows, place, gold_rows = [], [], []
    for b, (text, tokens, entities) in enumerate(data):
        covered = {t for i, j in entities for t in range(i, j)}
        for t, (s, e) in enumerate(tokens):
            rows.append(other(text[s:e]))
            place.append((b, t, t + 1, True))
            gold_rows.append(0 if t not in covered else -1)
        for i, j in segments(text, tokens):
            if j - i > MAX_TOKENS:  # the lattice of the fit is bounded; the programme isn't
                continue
            rows.append(features(text, tokens[i][0], tokens[j - 1][1], j - i))
            place.append((b, i, j, False))
            gold_rows.append(entities.get((i, j), -1))
    x = np.zeros((len(rows), len(_NAMES)))
    for r, on in enumerate(rows):
        x[r, on] = 1
    b, i, j, is_other = map(np.array, zip(*place))
    gold_rows = np.array(gold_rows)
    lengths = np.array([len(t) for _, t, _ in data])
    weights, first, second = (np.zeros((1 + len(KINDS), len(_NAMES))) for _ in range(3))
    observed = np.zeros_like(weights)
    for k in range(1 + len(KINDS)):
        observed[k] = x[gold_rows == k].sum(0)
    for step in range(1, steps + 1):
        scores = x @ weights.T
        scores[is_other, 1:] = scores[~is_other, :1] = -np.inf
        whole = np.logaddexp.reduce(scores, axis=1)
        lattice = np.full((len(data), longest + 1, MAX_TOKENS + 1, 2), -np.inf)
        lattice[b, j, j - i, is_other.astype(int)] = whole
        lattice = np.logaddexp(lattice[..., 0], lattice[..., 1])
        alpha = np.full((len(data), longest + 1), -np.inf)
        alpha[:, 0] = 0
        for t in range(1, longest + 1):
            most = min(t, MAX_TOKENS)
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - most : t][:, ::-1] + lattice[:, t, 1 : most + 1], axis=1)
        beta = np.full((len(data), longest + 1), -np.inf)
        beta[np.arange(len(data)), lengths] = 0
        for t in range(longest - 1, -1, -1):
            most = min(longest - t, MAX_TOKENS)
            steps_ = np.arange(1, most + 1)
            ahead = np.logaddexp.reduce(beta[:, t + steps_] + lattice[:, t + steps_, steps_], axis=1)
            beta[:, t] = np.where(t == lengths, 0, ahead)
        norm = alpha[np.arange(len(data)), lengths]
        share = np.exp(alpha[b, i][:, None] + scores + beta[b, j][:, None] - norm[b][:, None])
        slope = (observed - share.T @ x) / len(data) - penalty * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights = weights + 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def _ahead(text: str, stop: int) -> int:
    """How far a span that holds the end of the chunk before `stop` may reach."""
    for _ in range(MAX_TOKENS):
        if stop + 1 >= len(text) or text[stop] not in _GAP or not (chunk := _CHUNK.match(text, stop + 1)):
            break
        if not _group(_TOKEN.match(text, stop + 1).group()):
            break
        stop = chunk.end()
        if not all(_group(m.group()) for m in _TOKEN.finditer(text, chunk.start(), stop)):
            break
    return stop


def _behind(text: str, start: int) -> int:
    """The same the other way, for the chunk that begins at `start`."""
    for _ in range(MAX_TOKENS):
        if start < 2 or text[start - 1] not in _GAP or text[start - 2].isspace():
            break
        stop = start - 1
        begin = stop
        while begin and not text[begin - 1].isspace():
            begin -= 1
        tokens = [m.group() for m in _TOKEN.finditer(text, begin, stop)]
        if not _group(tokens[-1]):
            break
        start = begin
        if not all(map(_group, tokens)):
            break
    return start


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Chunks that hold a digit or an @ and all that a span with one of these may reach."""
    at, last = _HOT.search(text), None
    while at:
        start = at.start()
        while start and not text[start - 1].isspace():
            start -= 1
        blank = _SPACE.search(text, at.end())
        stop = blank.start() if blank else len(text)
        start, reach = _behind(text, start), _ahead(text, stop)
        if last and start <= last[1]:
            last = (min(start, last[0]), max(reach, last[1]))
        else:
            if last:
                yield last
            last = (start, reach)
        at = _HOT.search(text, stop)
    if last:
        yield last


def decode(text: str, weights: list[list[float]]) -> list[tuple[int, int, str]]:
    """Entities of the best division, in order."""
    out = []
    alone = weights[0][0]
    for start, stop in _stretches(text):
        tokens = [m.span() for m in _TOKEN.finditer(text, start, stop)]
        by_end: dict[int, list[tuple[int, float, int]]] = {}
        for i, j in segments(text, tokens):
            on = features(text, tokens[i][0], tokens[j - 1][1], j - i)
            score, kind = max((sum(w[f] for f in on), k) for k, w in enumerate(weights[1:]))
            if j - i > MAX_TOKENS:  # longer than any sequence of the fit: the run counts as one token
                score += alone * (j - i - 1)
            by_end.setdefault(j, []).append((i, score, kind))
        best, back = [0.0], [None]
        for t in range(1, len(tokens) + 1):
            value, from_ = best[t - 1] + alone, None
            for i, score, kind in by_end.get(t, ()):
                if best[i] + score > value:
                    value, from_ = best[i] + score, (i, kind)
            best.append(value)
            back.append(from_)
        t, found = len(tokens), []
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, kind = back[t]
                found.append((tokens[i][0], tokens[t - 1][1], KINDS[kind]))
                t = i
        out += reversed(found)
    return out


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for start, stop, kind in found:
        out += [text[last:start], f"[{kind}]"]
        last = stop
    return "".join([*out, text[last:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, entities (start, stop, kind) and the masked text of documents with entities."""
    table = (train() if weights is None else weights).tolist()

    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, entities, texts = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = decode(text, table)
                if found:
                    rows.append(i)
                    entities.append([{"start": a, "stop": b, "kind": k} for a, b, k in found])
                    texts.append(masked(text, found))
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.record_batch([ids, pa.array(entities, kind), pa.array(texts, pa.string())], names=["doc_id", "entities", "text"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]") | F.col("text").rlike(_HOT_TEXT.partition("|")[2]))
    return texts.mapInArrow(run, "doc_id long, entities array<struct<start:int,stop:int,kind:string>>, text string")


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", weights: np.ndarray | None = None) -> DataFrame:
    """All rows and columns of docs, the entities in texts replaced by their kinds in brackets and
    the length, where there is such a column, brought up to date."""
    table = (train() if weights is None else weights).tolist()

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, decode(t, table)) if isinstance(t, str) and _HOT.search(t) else t)

    out = docs.withColumn(text_col, mask(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
