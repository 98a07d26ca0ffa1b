"""Personal data by a semi-Markov conditional random field (operator 10).

The base patterns find plain e-mail addresses, IP addresses, card and phone numbers; their spans always stay.  The field reads the
regions around digits, @ and spelled-out "at" and "dot", scores whole candidate spans, and chooses boundaries and kinds together by dynamic programming
over spans of bounded length.  It adds spans that the patterns miss: obfuscated addresses, other separators, phones without a plus sign.

It is trained here, on the base spans of a bounded sample and on disguised copies of them; texts without any trigger hold no candidates.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as TY

from corpusloom.llm.common import documents, query, text_of

KINDS = ("email", "ip", "card", "phone")
#: Documents with triggers that the field is trained on (about; at most twice as many), and passes over their regions.
SAMPLE_DOCS, EPOCHS = 2000, 20
#: Most units of a span, and the least posterior probability of an added span.
LONGEST, SURE = 40, 0.8

Span = tuple[int, int, str]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failed digit run fails from each of its digits, so runs are entered at their first digit only and never given back
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Spelled signs: in brackets, a bare dot, and a bare at before what may be a domain (the lattice has no candidate at others).
SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]|\bdot\b|\bat\b(?=[\s)\]]+[a-z0-9-]+(?:\.[a-z0-9]|[\s(\[]*\bdot\b))", re.I)
TRIGGER = re.compile(f"[0-9@]|{SPELLED.pattern}", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_emails(text: str) -> list[Span]:
    """Matches of the e-mail pattern, entered from each @ so that time stays linear."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start and then by kind as listed."""
    found = base_emails(text)
    if "." in text:
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


DOT = re.compile(r"[(\[]?\bdot\b[)\]]?", re.I)
TOKEN, UNIT = re.compile(r"\S+"), re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+|\s+|.", re.S)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of tokens with digits, @ or spelled signs, and one token on each side; near stretches are one."""
    spelled = [m.start() for m in SPELLED.finditer(text)][::-1]
    tokens, hot = [], []
    for m in TOKEN.finditer(text):
        s = m.group()
        tokens.append(m.span())
        signs = len(spelled)
        while spelled and spelled[-1] < m.end():
            spelled.pop()
        if len(spelled) < signs or any("0" <= c <= "9" or c == "@" for c in s):
            hot.append(len(tokens) - 1)
    out: list[list[int]] = []
    for k in hot:
        if out and k - out[-1][1] <= 2:
            out[-1][1] = k
        else:
            out.append([k, k])
    merged: list[list[int]] = []
    for a, b in out:
        a, b = max(0, a - 1), min(len(tokens) - 1, b + 1)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(tokens[a][0], tokens[b][1]) for a, b in merged]


#: Top-level domains that count as usual. Fixed values.
TOPS = frozenset("com org net edu gov info biz io co de fr es it nl eu ch uk ca au jp br".split())


@dataclass
class Lattice:
    """Units of a region and its candidate spans (first unit, end unit, kind, features)."""

    units: list[tuple[int, int]]
    candidates: list[tuple[int, int, str, tuple[str, ...]]]


NUMERIC = frozenset(" +().-/[] ")


def lattice(text: str, lo: int, hi: int) -> Lattice:
    units = [(m.start(), m.end()) for m in UNIT.finditer(text, lo, hi)]
    s = [text[a:b] for a, b in units]
    n, found = len(units), []

    def sides(i: int, j: int) -> tuple[str, str]:
        a, b = units[i][0], units[j - 1][1]
        before, after = text[a - 1:a], text[b:b + 1]
        return ("left=" + ("word" if before.isalnum() or before in ("_", "+", "@") and before else "joined" if before in tuple(".-/") and before else "free"),
                "right=" + ("word" if after.isalnum() or after in ("_", "@") and after else "joined" if after in tuple("-/") and after else "free"))

    def add(i: int, j: int, kind: str, *features: str) -> None:
        found.append((i, j, kind, tuple(f"{kind}:{f}" for f in ("bias", *sides(i, j), *features))))

    for i in range(n):
        if not (s[i][0].isdigit() and s[i].isascii() or s[i] in ("+", "(")):
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            u = s[j - 1]
            if not (u.isascii() and u.isdigit() or all(c in NUMERIC for c in u) and len(u) <= 3):
                break
            if not (u[0].isdigit() and u.isascii()):
                continue
            span = text[units[i][0]:units[j - 1][1]]
            groups = re.findall(r"[0-9]+", span)
            seps = {x for x in re.split(r"[0-9]+", span)[1:-1]}
            d = "".join(groups)
            if len(d) > 19:
                break
            if len(groups) == 4 and s[i][0].isdigit() and len(d) <= 12 and len(seps) == 1 and "." in next(iter(seps)):
                add(i, j, "ip", "plain" if seps == {"."} else "spaced", "bytes" if all(int(g) <= 255 for g in groups) else "large")
            if 12 <= len(d) <= 19 and s[i][0].isdigit():
                add(i, j, "card", "luhn" if luhn(d) else "odd", "solid" if not seps else "one separator" if len(seps) == 1 else "mixed",
                    "16" if len(d) == 16 else "other length", "fours" if len(groups) > 1 and {len(g) for g in groups[:-1]} == {4} else "groups")
            if 7 <= len(d) <= 15:
                add(i, j, "phone", "plus" if span[0] == "+" else "no plus", "long" if len(d) >= 9 else "short",
                    "area" if re.match(r"(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)", span) else "no area",
                    "open" if span.count("(") != span.count(")") else "closed", "solid" if not seps else "parts",
                    "tail" if len(groups) > 1 and [len(g) for g in groups[-2:]] == [3, 4] else "other tail",
                    "dots" if seps and all("." in x for x in seps) else "no dots")
    joins = [k for k in range(n) if s[k] == "@" or s[k].lower() == "at"]
    for k in joins:
        word = s[k] != "@"
        a = k - 1
        while a >= 0 and s[a] in (" ", "(", "["):
            a -= 1
        z = k + 1
        while z < n and s[z] in (" ", ")", "]"):
            z += 1
        if a < 0 or z >= n or not s[a].isascii() or not s[a].isalnum() or not s[z].isascii() or not s[z].isalnum():
            continue
        starts = [a]
        while starts[-1] > 0 and k - starts[-1] < LONGEST // 2 and all(c in LOCAL for c in s[starts[-1] - 1]):
            starts.append(starts[-1] - 1)
        first = min(x for x in starts if s[x].isalnum())
        ends, e, dots, spelled = [], z + 1, 0, 0
        while e < n and e - k < LONGEST // 2:
            m = DOT.match(text, units[e][0]) or DOT.match(text, units[e][0] + 1) if s[e] in (" ", "(", "[") or s[e].lower() == "dot" else None
            if s[e] == "." and e + 1 < n and s[e + 1].isascii() and s[e + 1].isalnum():
                dots, e = dots + 1, e + 2
                ends.append((e, dots, spelled))
            elif m and m.end() < units[-1][1]:
                f = next((x for x in range(e, n) if units[x][0] >= m.end() and s[x] not in (" ", ")", "]")), n)
                if f >= n or not s[f].isascii() or not s[f].isalnum():
                    break
                dots, spelled, e = dots + 1, spelled + 1, f + 1
                ends.append((e, dots, spelled))
            elif s[e] == "-" and e + 1 < n and s[e + 1].isascii() and s[e + 1].isalnum():
                e += 2
            elif s[e].isascii() and s[e].isalnum():
                e += 1
                if ends:
                    ends[-1] = (e, dots, spelled)
            else:
                break
        for e, dots, spelled in ends:
            top = s[e - 1]
            more = e < n and (s[e] == "." and e + 1 < n and s[e + 1].isalnum() or DOT.match(text, units[e][0]) is not None or e + 1 < n and s[e] == " " and s[e + 1].lower() == "dot")
            add(first, e, "email", "at word" if word else "at sign", "spelled" if spelled else "dots", "usual top" if top.lower() in TOPS else "letters" if 2 <= len(top) <= 6 and top.isalpha() else "no top",
                "spelled, usual top" if spelled and top.lower() in TOPS else "spelled, other top" if spelled else "plain top",
                "more follows" if more else "ends", "word but no spelled dot" if word and not spelled else "even",
                "at in brackets" if word and s[k - 1] in ("(", "[") else "no brackets", "spaces" if " " in text[units[k][0] - 1:units[k][1] + 1] else "tight")
    return Lattice(units, found)


@dataclass
class Field:
    """Weights of span features; a unit outside spans has weight 0."""

    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, lat: Lattice) -> np.ndarray:
        w = self.weights
        return np.array([sum(w.get(f, 0.0) for f in c[3]) for c in lat.candidates])

    def posteriors(self, lat: Lattice, score: np.ndarray) -> np.ndarray:
        """Probability of each candidate by the forward and backward sums over all segmentations."""
        n = len(lat.units)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, *_rest) in enumerate(lat.candidates):
            ending[j].append(k)
            starting[i].append(k)
        f, b = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            f[j] = f[j - 1]
            for k in ending[j]:
                f[j] = np.logaddexp(f[j], f[lat.candidates[k][0]] + score[k])
        for i in range(n - 1, -1, -1):
            b[i] = b[i + 1]
            for k in starting[i]:
                b[i] = np.logaddexp(b[i], b[lat.candidates[k][1]] + score[k])
        return np.array([np.exp(min(0.0, f[i] + score[k] + b[j] - f[n])) for k, (i, j, *_rest) in enumerate(lat.candidates)])

    def best(self, lat: Lattice, score: np.ndarray) -> list[int]:
        """Candidates of the best segmentation."""
        n = len(lat.units)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, c in enumerate(lat.candidates):
            ending[c[1]].append(k)
        top, how = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for k in ending[j]:
                if (v := top[lat.candidates[k][0]] + score[k]) > top[j]:
                    top[j], how[j] = v, k
        out, j = [], n
        while j > 0:
            if how[j] < 0:
                j -= 1
            else:
                out.append(how[j])
                j = lat.candidates[how[j]][0]
        return out[::-1]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field adds: of the best segmentation, sure, and apart from all base spans."""
        added = []
        for lo, hi in regions(text):
            lat = lattice(text, lo, hi)
            if not lat.candidates:
                continue
            score = self.scores(lat)
            chosen = [k for k in self.best(lat, score)]
            if not chosen:
                continue
            sure = self.posteriors(lat, score)
            for k in chosen:
                i, j, kind, _ = lat.candidates[k]
                a, z = lat.units[i][0], lat.units[j - 1][1]
                if sure[k] >= SURE and all(z <= x or y <= a for x, y, _ in base):
                    added.append((a, z, kind))
        return added

    def train(self, examples: list[tuple[Lattice, set[int]]], epochs: int = EPOCHS) -> None:
        """Ascend the likelihood of the right candidates with AdaGrad."""
        square: dict[str, float] = {}
        order = random.Random(5)
        examples = [x for x in examples if x[0].candidates]
        for _ in range(epochs):
            order.shuffle(examples)
            for lat, right in examples:
                p = self.posteriors(lat, self.scores(lat))
                slope: dict[str, float] = {}
                for k, c in enumerate(lat.candidates):
                    d = (k in right) - p[k]
                    if abs(d) > 1e-4:
                        for x in c[3]:
                            slope[x] = slope.get(x, 0.0) + d
                for x, g in slope.items():
                    square[x] = square.get(x, 1e-2) + g * g
                    self.weights[x] = self.weights.get(x, 0.0) * 0.9995 + 0.5 * g / square[x] ** 0.5


def disguised(value: str, kind: str, draw: random.Random) -> str:
    """A copy of a span as people write it to evade patterns."""
    if kind == "email":
        local, _, domain = value.partition("@")
        domain = domain.rpartition(".")[0] + "." + draw.choice(sorted(TOPS))
        at, dot = draw.choice([*[(" at ", " dot ")] * 3, (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", "."), (" [at] ", "."), (" (at) ", ".")])
        return local.strip(".") + at + domain.replace(".", dot)
    if kind == "ip":
        return value.replace(".", draw.choice(["[.]", " . ", "(.)"]))
    d = digits_of(value)
    if kind == "card":
        sep = draw.choice([".", "/", " - ", "  "])
        return sep.join(d[k:k + 4] for k in range(0, len(d), 4))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return draw.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}" if len(d) < 9 else f"({a}) {b} {c}", f"({a}){b}-{c}"]) if len(d) >= 10 else value


def examples_of(text: str, seed: int) -> list[tuple[Lattice, set[int]]]:
    """Training regions of a text, each span once as it is and once disguised."""
    base, out = base_spans(text), []
    draw = random.Random(seed)

    def learn(t: str, spans: list[Span], lo: int, hi: int) -> None:
        lat = lattice(t, lo, hi)
        right = {k for k, (i, j, kind, _) in enumerate(lat.candidates) if (lat.units[i][0], lat.units[j - 1][1], kind) in spans}
        out.append((lat, right))

    for lo, hi in regions(text):
        inside = [s for s in base if lo <= s[0] and s[1] <= hi]
        learn(text, inside, lo, hi)
        if len(inside) == 1:
            a, z, kind = inside[0]
            new = disguised(text[a:z], kind, draw)
            t = text[lo:a] + new + text[z:hi]
            learn(t, [(a - lo, a - lo + len(new), kind)], 0, len(t))
            if kind == "email":  # ordinary words around at and dot are no address
                w = [x for x in text.split(None, 60)[:60] if x.isascii() and x.isalpha()] or ["word"]
                t = f"{draw.choice(w)} {draw.choice(w)} at {draw.choice(w)} dot {draw.choice(w)} {draw.choice(w)}"
                learn(t, [], 0, len(t))
                t = f"{draw.choice(w)} {draw.choice(w)} at {draw.choice(w)}.{draw.choice(w)} {draw.choice(w)}"
                learn(t, [], 0, len(t))
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_DOCS) -> Field:
    """A field trained on about ``rows`` documents that hold triggers, chosen by a hash of their ids; untrained (adds nothing) without any."""
    model = Field()
    hot = docs.filter(F.col(text).rlike("[0-9@]"))
    share = min(1.0, rows / max(1, hot.count()))
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 20))
    sample = hot.filter(place < F.lit(int(share * (1 << 20)))).select(doc_id, text).limit(2 * rows).collect()
    examples: list = []
    for i, t in sorted(sample, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        examples += examples_of(t, int(i or 0))
    if any(right for _, right in examples):
        model.train(examples)
    return model


def span_text(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{a}:{z}" for a, z, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))])


SPANS = TY.ArrayType(TY.StructType([TY.StructField("start", TY.IntegerType()), TY.StructField("end", TY.IntegerType()),
                                    TY.StructField("kind", TY.StringType()), TY.StructField("base", TY.BooleanType())]))


def find_spans(docs: DataFrame, model: Field, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``spans``: start, end (code points, end exclusive), kind, and whether a base pattern gave it.

    Whole texts are read; null counts as empty and has no spans.  Base spans of different kinds may overlap; added ones overlap none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen weights

    def run(batches):
        field_ = held.value
        for b in batches:
            found = []
            for t in b.column(len(keys)).to_pylist():
                if not TRIGGER.search(t):
                    found.append([])
                    continue
                base = base_spans(t)
                rows = [(a, z, k, True) for a, z, k in base] + [(a, z, k, False) for a, z, k in field_.spans(t, base)] if field_.weights else [(a, z, k, True) for a, z, k in base]
                found.append([dict(zip(("start", "end", "kind", "base"), r)) for r in sorted(rows, key=lambda s: (s[0], KINDS.index(s[2])))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*keys, "spans"])

    schema = TY.StructType([*(docs.schema[k] for k in keys), TY.StructField("spans", SPANS)])
    return docs.select(*keys, text_of(text).alias("_text")).mapInArrow(run, schema)


def masked(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        at = docs_columns.index(text)
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t and TRIGGER.search(t):
                    base, done, parts = base_spans(t), 0, []
                    for a, z, kind in sorted([*base, *(held.value.spans(t, base) if held.value.weights else [])], key=lambda s: (s[0], KINDS.index(s[2]))):
                        if a >= done:
                            parts += [t[done:a], f"[{kind}]"]
                        done = max(done, z)
                    t = "".join(parts) + t[done:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    docs_columns = docs.columns
    return docs.mapInArrow(run, docs.schema)


@query("op10_pii")
def op10_pii(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_spans(docs, train(docs), ["doc_id"])
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda k: lambda s: s["kind"] == k
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
