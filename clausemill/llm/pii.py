"""Personal data: patterns plus a skip-chain conditional random field (operator 5).

Base spans come from fixed patterns (e-mail, IP address, card number, phone number),
leftmost and non-overlapping for each kind.  The field adds spans of these kinds and of
secrets (keys and tokens that a text assigns).

Its nodes are the tokens that are not plain words: those with a digit or an @, the token
after an equals sign, and those around a spelt-out (at) or (dot); plain words are none of
the kinds.  A node's label is none, or the begin or inside of a kind.  Features of a token
(its shape, checks of its digits, the word and the signs before it) give its own
potential, neighbours share a transition potential, and distant tokens that repeat or
resemble each other (the same letters and digits, the same last seven digits, the same
name before an @) share a skip potential that asks for the same kind.  Loopy sum-product
message passing over all tokens of a document decides; tokens of base spans are observed.
A mention in a skip group has one factor with the group's observed mentions, so that any number
of unobserved ones cannot outvote these; a group without observed ones is tied through one hub node
instead of through all pairs, so a document with thousands of copies of a number costs as many
messages.
Tokens that follow one another and make up one number repeat as a whole.

All potentials are fitted by pseudo-likelihood on weak labels: base spans, and values
that a text assigns to a key, token or password, in a sample of about ``sample_docs`` texts of
at most ``sample_chars`` characters.  Every span of the sample is put once more behind its
text in a weaker form (without country code, spelt out, another alphabet), so that the
field learns forms that no pattern has, and what a repeat tells; and every text gets a few
ordinary numbers, years, times and amounts, which are none of the kinds.

Null text counts as empty, an empty table gives an empty result; rows that share a doc_id
are read each for itself; columns beside doc_id and text are ignored by ``find`` and kept
by ``redact``, whatever their names.  Where nothing can be learnt, base spans are all.
Row-local but for the sample: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import steps

KINDS = ("email", "ip", "card", "phone")
#: With what only the field finds.
ALL = (*KINDS, "secret")
LABELS = 1 + 2 * len(ALL)  # none, then begin and inside of each kind
KIND_OF = (np.arange(LABELS) + 1) // 2
#: How much more than the learnt skip potential the factor with an observed mention counts: what was learnt is the share among all others.
OBSERVED = 1.5
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _address(text: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or "0") < 256 for x in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards, so the time is linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        else:
            end = at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    out: list[tuple[int, int, int]] = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _address(m[0])]
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    out.sort()
    return [(KINDS[k], a, b) for a, k, b in out]



_TOKEN = re.compile(r"[^\x09-\x0D\x20\"',;<>=|]+")
_GAP = re.compile(r"[\x09-\x0D\x20\"',;<>=|]{0,4}")
_EDGE = frozenset("\t\n\x0b\x0c\r \"',;<>=|")
_SEED = re.compile(r"[0-9@]+|=")
_SEED_SPELT = re.compile(r"[0-9@]+|=|[\[(](?:at|dot)[\])]", re.I)
_SPELT = re.compile(r"[\[(](?:at|dot)[\])]", re.I)
_RUN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7F]+")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_KEY = re.compile(r"[A-Za-z0-9_/+-]{16,}")
#: Weak labels of secrets.
_ASSIGNED = re.compile(r"(?i)(?:token|key|secret|password|passwd|pwd|credential)\x20{0,3}[:=]\x20{0,3}[\"']?([^\x09-\x0D\x20\"',;<>=|]{8,})")
_OTHER = re.compile(r"[^a-z0-9]")
#: A token that can be part of a number written in several.
_NUMERAL = re.compile(r"[+(]*[0-9][0-9().+-]*[.:!?]*")


def tokens(text: str) -> list[tuple[int, int]]:
    """The tokens of a text that are nodes, in order."""
    spelt = "(" in text or "[" in text
    out: dict[int, int] = {}
    done = 0  # seeds before this place are inside of a known token

    def back(at: int) -> int:
        while at > 0 and text[at - 1] not in _EDGE:
            at -= 1
        return at

    for m in (_SEED_SPELT if spelt else _SEED).finditer(text):
        at = m.start()
        if m[0] == "=":
            if t := _TOKEN.match(text, _GAP.match(text, m.end()).end()):
                out.setdefault(t.start(), t.end())
                done = max(done, t.end())
            continue
        if at < done:
            continue
        a = back(at)
        end = _TOKEN.match(text, at).end()
        out.setdefault(a, end)
        done = end
        if spelt and _SPELT.match(m[0]):
            before = a
            while before > 0 and text[before - 1] == " ":
                before -= 1
            if before < a and before and (own := back(before)) < before:
                out.setdefault(own, before)
            if (t := _TOKEN.search(text, end)) and not text[end : t.start()].strip(" "):
                out.setdefault(t.start(), t.end())
                done = t.end()
    return sorted(out.items())


def shape(token: str) -> str:
    """A token's kinds of characters, with the lengths of its runs of digits."""
    if _HEX.fullmatch(token):
        return "hex"
    if len(token) >= 16 and _KEY.fullmatch(token) and _DIGIT.search(token) and re.search("[A-Za-z]", token):
        return "key"

    def run(m):
        x = m[0]
        if x[0].isdigit():
            n = len(x)
            return str(n if n < 5 else 5 if n < 7 else 7 if n < 10 else 10 if n < 14 else 14 if n < 20 else 20)
        return "a" if x[0] < "\x80" and x[0].islower() else "A" if x[0] < "\x80" else "u"

    runs = _RUN.sub(run, token)
    return runs if len(runs) <= 24 else f"{''.join(sorted(set(runs)))}{len(runs).bit_length()}"


def features(text: str, a: int, b: int, follows: bool) -> list[str]:
    """What a token shows of itself and of what stands before it."""
    token = text[a:b].rstrip(".:!?")
    bare = token.strip("()[]")
    digits = _NO_DIGIT.sub("", bare)
    head = text[max(0, a - 24) : a]
    word = head.rstrip(" \t\"'=:,;<>|")
    last = re.split(r"[^A-Za-z]", word.lower())[-1] if word else ""
    out = [f"s{shape(token)}", f"d{min(len(digits), 20)}", f"g{head[len(word):][-4:]}", "follows" if follows else "first", "any"]
    if last and len(head) - len(word) <= 6:
        out.append(f"w{last[:12]}")
    if 14 <= len(digits) <= 19:
        out.append(f"luhn{luhn(digits)}")
    if bare.count(".") == 3 and _IP.fullmatch(bare):
        out.append(f"ip{_address(bare)}")
    return out


def keys(token: str) -> list[str]:
    """What tokens must share to count as repeated or similar."""
    out = []
    low = _OTHER.sub("", token.lower())
    if len(low) >= 7:
        out.append(f"t{low}")
    digits = _NO_DIGIT.sub("", token)
    if 7 <= len(digits) <= 19:
        out.append(f"s{digits[-7:]}")
    name = _OTHER.sub("", token.split("@")[0].lower())
    if len(name) >= 5 and name != low or "@" not in token and len(name) >= 5:
        out.append(f"n{name}")
    return out


@dataclass(frozen=True)
class Field:
    """Fitted log potentials: of features, of neighbouring labels, and of the same kind in a skip group."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    skip: float = 0.0
    rounds: int = 12
    damping: float = 0.3


def beliefs(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, tables: np.ndarray, rounds: int, damping: float) -> np.ndarray:
    """Marginals by loopy sum-product: node log potentials (n, L), edges (m, 2), each edge's table (m), log tables (t, L, L)."""
    n, labels = unary.shape
    m = len(edges)
    total = unary
    if m:
        src = np.concatenate((edges[:, 0], edges[:, 1]))
        dst = np.concatenate((edges[:, 1], edges[:, 0]))
        back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
        ways = [(np.flatnonzero(kinds == t) + side * m, np.exp(tables[t].T if side else tables[t])) for t in range(len(tables)) for side in (0, 1)]
        order = np.argsort(dst, kind="stable")
        first = np.flatnonzero(np.diff(dst[order], prepend=-1))
        messages = np.zeros((2 * m, labels))
        for k in range(rounds + 1):
            total = unary.copy()
            total[dst[order][first]] += np.add.reduceat(messages[order], first)
            if k == rounds:
                break
            out = total[src] - messages[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(messages)
            for own, table in ways:
                new[own] = np.log(out[own] @ table)
            new -= new.max(1, keepdims=True)
            messages = damping * messages + (1 - damping) * new
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Graph:
    """Tokens of some texts as one graph: nodes, chain edges, skip groups and the labels of known spans."""

    def __init__(self):
        self.owner, self.at, self.features, self.labels = [], [], [], []
        self.chain: list[int] = []  # second nodes of neighbours
        self.groups: list[list[int]] = []

    def add(self, owner: int, text: str, known: list[Span]) -> None:
        own = tokens(text)
        groups: dict[str, list[int]] = {}
        begin, k, end = len(self.at), 0, -2
        ordered = sorted((a, b, ALL.index(kind)) for kind, a, b in known)
        started: set[int] = set()
        run: list[int] = []
        whole: list[list[int]] = []
        for a, b in own:
            i = len(self.at)
            follows = i > begin and a - end <= 2 and not text[end:a].strip(" ")
            while k < len(ordered) and ordered[k][1] <= a:
                k += 1
            label, look = 0, k
            while look < len(ordered) and ordered[look][0] < b:  # spans are ordered by start; those that ended are passed over
                if ordered[look][1] > a:
                    label = 1 + 2 * ordered[look][2] + (look in started)
                    started.add(look)
                    break
                look += 1
            self.owner.append(owner)
            self.at.append((a, b))
            self.features.append(features(text, a, b, follows))
            self.labels.append(label)
            if follows:
                self.chain.append(i)
            end = b
            for key in keys(text[a:b]):
                groups.setdefault(key, []).append(i)
            run = [*run, i] if follows and run and _NUMERAL.fullmatch(text, a, b) else [i] if _NUMERAL.fullmatch(text, a, b) else []
            if len(run) > 1:
                whole.append(run)
        mention: dict[int, int] = {}  # tokens of one number are one mention
        for k, run in enumerate(whole):  # numbers in several tokens, by their last digits; the longest of those that begin alike
            if k + 1 == len(whole) or whole[k + 1][0] != run[0]:
                mention.update(dict.fromkeys(run, run[0]))
                digits = _NO_DIGIT.sub("", text[self.at[run[0]][0] : self.at[run[-1]][1]])
                if 7 <= len(digits) <= 19:
                    groups.setdefault(f"s{digits[-7:]}", []).extend(run)
        sets = (sorted(set(g)) for g in groups.values())
        self.groups += {tuple(g): g for g in sets if len({mention.get(i, i) for i in g}) > 1}.values()

    def marginals(self, model: Field) -> np.ndarray:
        """Of every node's labels, with those of known spans observed."""
        n = len(self.at)
        none = np.zeros(LABELS)
        unary = np.array([sum((model.weights.get(f, none) for f in own), none) for own in self.features]).reshape(n, LABELS)
        labels = np.array(self.labels, np.int64)
        known = np.flatnonzero(labels)
        unary[known] = -30.0
        unary[known, labels[known]] = 30.0
        hubs, tied = 0, []
        for own in self.groups:
            seen = labels[own]
            kinds = np.bincount(KIND_OF[seen[seen > 0]], minlength=1 + len(ALL))
            free = [i for i, x in zip(own, seen.tolist(), strict=True) if not x]
            if kinds.any():  # a factor with what is observed, for every other mention, however many there are
                unary[free] += OBSERVED * model.skip * (kinds / kinds.sum())[KIND_OF]
            elif len(free) > 1:
                tied += [(i, n + hubs) for i in free]
                hubs += 1
        hub = np.full((hubs, LABELS), -30.0)
        hub[:, 0] = hub[:, 1::2] = 0.0
        chain = np.array([(i - 1, i) for i in self.chain], np.int64).reshape(-1, 2)
        tied = np.array(tied, np.int64).reshape(-1, 2)
        tables = np.stack((model.chain, model.skip * (KIND_OF[:, None] == KIND_OF)))
        kinds = np.repeat((0, 1), (len(chain), len(tied)))
        return beliefs(np.vstack((unary, hub)), np.concatenate((chain, tied)), kinds, tables, model.rounds, model.damping)[:n]


def weaker(kind: str, value: str, r: random.Random) -> str:
    """A span's value in a form that the patterns do not have."""
    if kind == "email":
        at, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "."), (" [at] ", ".")))
        name, place = value.rsplit("@", 1)
        return f"{name}{at}{place.replace('.', dot)}"
    if kind == "phone":
        digits = _NO_DIGIT.sub("", value)
        short = value[1:].lstrip("0123456789").strip(" ") or digits
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return r.choice((short, short, short, digits[-10:], digits[-7:], f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"{b}-{c}"))
    if kind == "card":
        return r.choice((value, "-".join(re.findall("[0-9]{1,4}", _NO_DIGIT.sub("", value)))))
    if kind == "secret":
        return base64.urlsafe_b64encode(hashlib.sha256(value.encode()).digest())[: max(20, len(value) // 2)].decode()
    return value


#: Forms of ordinary numbers; each # is a digit.
ORDINARY = "19## 20## # ## ### #### ##### ###### ####### ######## ########## #.# ##.## #,### ##,### ##:## #:## 20##-0#-1# ##.0#.20## 1#/0#/20## ##% $### ##.##€ v#.#.# #.#.# #th (##) [#] #a ###-### ##-## ##x## no.# a=# x# ###kg (#### ####)".split()


def ordinary(r: random.Random) -> str:
    return re.sub("#", lambda _: str(r.randrange(10)), r.choice(ORDINARY))


def learn(texts: list[str], least: int = 3, steps_: int = 200, decay: float = 1e-4) -> Field:
    """Potentials from weakly labelled texts, by pseudo-likelihood."""
    graph = Graph()
    for k, text in enumerate(texts):
        known = base_spans(text)
        known += [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text) if not any(a < m.end(1) and b > m.start(1) for _, a, b in known)]
        r = random.Random(k)
        for kind, a, b in list(known)[:20]:  # bounds the copies behind a text of the sample, no more
            own = text[a:b]
            if kind == "phone" and r.random() < 0.5:  # another number: what a form tells without a repeat
                own = "+" + re.sub("[0-9]", lambda _: str(r.randrange(10)), own[1:])
            again = weaker(kind, own, r)
            text += " and "
            known.append((kind, len(text), len(text) + len(again)))
            text += again
        text += "".join(f" {r.choice(('in', 'of', 'the', 'about', 'and', ''))} {ordinary(r)}" for _ in range(8))
        graph.add(k, text, known)
    n = len(graph.at)
    counts = Counter(f for own in graph.features for f in own)
    names = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least))}
    labels = np.array(graph.labels, np.int64)
    if not n or not labels.any():
        return Field()
    row = np.array([i for i, own in enumerate(graph.features) for f in own if f in names], np.int64)
    col = np.array([names[f] for own in graph.features for f in own if f in names], np.int64)
    after = np.array(graph.chain, np.int64)
    share = np.zeros((n, 1 + len(ALL)))  # of each kind among the others of a node's skip groups
    for own in graph.groups:
        kinds = np.bincount(KIND_OF[labels[own]], minlength=share.shape[1])
        for i in own:
            other = kinds.copy()
            other[KIND_OF[labels[i]]] -= 1
            share[i] += other / other.sum()
    truth = np.eye(LABELS)[labels]
    w, chain, skip = np.zeros((len(names), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, chain, skip)]
    for t in range(1, steps_ + 1):
        score = np.zeros((n, LABELS))
        np.add.at(score, row, w[col])
        score[after] += chain[labels[after - 1]]
        score[after - 1] += chain.T[labels[after]]
        score += skip * share[:, KIND_OF]
        p = np.exp(score - score.max(1, keepdims=True))
        off = truth - p / p.sum(1, keepdims=True)
        gw = np.zeros_like(w)
        np.add.at(gw, col, off[row])
        gc = np.zeros_like(chain)
        np.add.at(gc, labels[after - 1], off[after])
        np.add.at(gc.T, labels[after], off[after - 1])
        gs = np.array([(off * share[:, KIND_OF]).sum()])
        for x, g, (m1, m2) in zip((w, chain, skip), (gw, gc, gs), moments, strict=True):
            g = g / n - decay * x
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            x += 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    # a hub passes on less than a pair would
    return Field({f: w[i] for f, i in names.items()}, chain, 2.0 * float(np.clip(skip[0], 0.0, 4.0)))


def fit(docs: DataFrame, sample_docs: int = 2_000, sample_chars: int = 20_000) -> Field:
    """A field from about ``sample_docs`` of the distinct texts that have candidates, chosen by a hash of the text.

    Their number is estimated first, so that every task sends its share of the sample
    and no more; of a text with very many copies a task sends one.
    """
    own = docs.select("text").where(F.length("text") <= sample_chars).where(F.col("text").rlike("[0-9@=]")).withColumn("hash", F.xxhash64("text"))
    n = own.agg(F.approx_count_distinct("hash")).first()[0]
    share = int(1_000_000_000 * min(1.0, sample_docs / max(1, n)))
    chosen = own.where(F.pmod("hash", F.lit(1_000_000_000)) < share).groupBy("hash", "text").agg(F.count("*"))
    return learn([r.text for r in sorted(chosen.select("hash", "text").collect())])


def added(text: str, at: list[tuple[int, int]], marginals: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of tokens whose kind the field makes likelier than not, outside of base spans."""
    out: list[list] = []
    for (a, b), p in zip(at, marginals, strict=True):
        kinds = np.bincount(KIND_OF, weights=p)
        kind = int(kinds.argmax())
        if not kind or kinds[kind] < 0.5:
            continue
        inside = p[2 * kind] > p[2 * kind - 1]
        if inside and out and out[-1][0] == kind and not text[out[-1][2] : a].strip(" "):
            out[-1][2] = b
        else:
            out.append([kind, a, b])
    taken = sorted((a, b) for _, a, b in base)
    found, k, reach = [], 0, 0
    for kind, a, b in out:
        own = text[a:b]
        left = own.lstrip("([{:" if ALL[kind - 1] != "phone" else "[{:")
        a, own = b - len(left), left.rstrip(".:!?])}" if "(" not in left else ".:!?]}")
        b = a + len(own)
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a < b and reach <= a:
            found.append((ALL[kind - 1], a, b))
    return found


def find_all(texts: list[str | None], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans by start, then kind as listed) of each text."""
    graph = Graph()
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    for k, text in enumerate(texts):
        if model.weights and _SEED.search(text) or "(" in text or "[" in text:
            graph.add(k, text, base[k])
    marginals = graph.marginals(model) if model.weights and graph.at else np.zeros((len(graph.at), LABELS))
    edge = [0, *(i for i in range(1, len(graph.owner)) if graph.owner[i] != graph.owner[i - 1]), len(graph.owner)]
    out = [(own, own) for own in base]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a < b:
            k = graph.owner[a]
            more = added(texts[k], graph.at[a:b], marginals[a:b], base[k])
            if more:
                out[k] = base[k], sorted({*base[k], *more}, key=lambda x: (x[1], ALL.index(x[0]), x[2]))
    return out


def spans(text: str | None, model: Field) -> list[Span]:
    """All spans of a text by start, then kind as listed; base spans are always among them."""
    return find_all([text], model)[0][1]


def listed(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long"


def find(docs: DataFrame, model: Field) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans, with how many these are and the field added."""

    def run(batches):
        for batch in steps(batches):
            rows = []
            for base, own in find_all(batch.column("text").to_pylist(), model):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(own), len(own), len(own) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COLUMNS)


def masked(text: str | None, own: list[Span]) -> str | None:
    """The text with every span replaced by its kind, as in <EMAIL>; overlapping spans become one."""
    if not text or not own:
        return text
    out, at = [], 0
    for kind, a, b in own:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(text: str | None, model: Field) -> str | None:
    return masked(text, spans(text, model))


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """The same rows and columns with spans masked; n_chars, where there is one, follows the text."""

    def run(batches):
        for batch in steps(batches):
            texts = batch.column("text").to_pylist()
            texts = [masked(t, own) for t, (_, own) in zip(texts, find_all(texts, model), strict=True)]
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                kind = batch.schema.field(at).type
                out = out.set_column(at, "n_chars", pa.array([None if t is None else len(t) for t in texts], kind))
            yield out

    return docs.mapInArrow(run, docs.schema)
