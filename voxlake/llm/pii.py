"""Information-theoretic sanitisation of personal data.

Base spans come from patterns (email, ip, card, phone). The protected entities
are the values found and the classes each value belongs to: its kind; an email's
domain and the words of its local part; an address's nets of 24 and 16 bits; a card's
issuer digits; a phone's country and area. A value that stands in one text or two
has too few texts for statistics of its own and is protected through its classes.

The words of a text that holds an entity, outside base spans, are its context,
however far off; a run of letters inside an identifier or a number is no word. Over the corpus the pointwise mutual information of a word t and
an entity c, PMI = log(n_ct N / (n_c n_t)) with counts of distinct texts, is
compared with the entity's own information IC = log(N / n_c): a word whose PMI/IC
reaches `generalise` with any entity discloses it and is generalised to a
placeholder wherever it stands, in texts without the entity too; from `remove` on
it is removed. A pair counts as evidence only from `support` distinct texts on, and only
if it lies `sigmas` standard deviations above what chance gives (n_c n_t / N), so that
neither a word seen once nor an entity in very many texts makes disclosures by
accident. Byte-identical texts count as one.

Defined results: a null text is empty; a text of any length is taken whole; base
spans always stay, and a term that touches one isn't added; of overlapping base spans
sanitise() replaces the first; repeated rows get equal spans; a null doc_id stays null;
a text without spans has the hash of the empty string; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batches_of, bit_filter, hash64, hash_words, in_filter, in_filter_all, map_rows, materialize, pieces, release

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Two letters or more with no letter, digit or _ beside them: a whole word, never a part of an identifier.
TERM = re.compile(r"\b[^\W\d_]{2,}\b")
FOUND = (
    "doc_id long, tkey long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<k:int,s:int,e:int>>, "
    "entities array<long>, terms array<long>"
)
HELD = 200_000


def emails(t: str):
    """Leftmost non-overlapping matches, found from each @: the local part is the run of its characters before it."""
    end, at = 0, t.find("@")
    while at >= 0:
        s = at
        while s > end and t[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield s, m.end()
            end = m.end()
        at = t.find("@", max(at + 1, end))


def addresses(t: str):
    """Runs of dotted numbers, cut four by four from the left."""
    for run in DOTTED.finditer(t):
        parts = list(PART.finditer(t, run.start(), run.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(v := p.group().lstrip("0")) <= 3 and int(v or "0") <= 255 for p in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(t: str):
    for m in CARD.finditer(t):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := re.sub(r"[ -]", "", m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(t: str):
    for m in PHONE.finditer(t):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed and then start."""
    return [(k, s, e) for k, find in enumerate(FINDERS) for s, e in find(text)]


def classes_of(kind: int, value: str) -> set[str]:
    """The names of a value and of the classes it belongs to."""
    norm = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    own = [norm, ""]
    if kind == 0:
        local, _, domain = norm.partition("@")
        own += ["@" + domain, *(w + "@" for w in re.findall(r"[a-z]{3,}", local))]
    elif kind == 1:
        parts = [p.lstrip("0") or "0" for p in norm.split(".")]
        own += [".".join(parts[:3]) + ".", ".".join(parts[:2]) + "."]
    elif kind == 2:
        own.append(norm[:6] + "-")
    else:
        own.append(norm[:-7] + "-")
    return {f"{KINDS[kind]}:{x}" for x in own}


def entities_of(text: str, base: list[tuple[int, int, int]]) -> set[int]:
    """The hashes of all protected entities of a text."""
    return {hash64(x.encode()) for k, s, e in base for x in classes_of(k, text[s:e])}


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def free_terms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(folded term, start, end) of every term that touches no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    ends = list(accumulate((e for _, e in taken), max))
    out = []
    for m in TERM.finditer(text):
        a, b = m.span()
        n = bisect_left(starts, b)
        if not n or ends[n - 1] <= a:
            out.append((m.group().lower(), a, b))
    return out


def term_set(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """The distinct folded terms of a text outside its base spans."""
    return {w for w, _, _ in free_terms(text, base)} if base else {w.lower() for w in set(TERM.findall(text))}


def wanted_terms(texts: list[str], bits: np.ndarray) -> list[dict[str, int]]:
    """For each text its terms, as they are written, that a filter of term hashes lets pass, with their hashes.

    The distinct terms of all the texts are hashed once and looked up together.
    """
    sets = [set(TERM.findall(t)) for t in texts]
    every = list(set().union(*sets))
    hashes = hash_words([w.lower().encode() for w in every]).view(np.int64)
    held = {every[i]: int(hashes[i]) for i in np.flatnonzero(in_filter_all(bits, hashes))}
    return [{w: held[w] for w in own & held.keys()} for own in sets]


def outside(places: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The places that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    return [(s, e) for s, e in places if not (n := bisect_left(starts, e)) or ends[n - 1] <= s]


def with_key(docs: DataFrame, name: str = "tkey") -> DataFrame:
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def scanned(docs: DataFrame) -> DataFrame:
    """Spans and entities of every document, and the terms of texts with entities (once a task for copies)."""

    schema = arrow_schema(FOUND)

    def run(it):
        seen: set[int] = set()

        def rows():
            for b in pieces(it):
                for doc_id, key, text in zip(*(c.to_pylist() for c in b.columns)):
                    t = text or ""
                    base = base_spans(t)
                    kinds = np.bincount([k for k, _, _ in base], minlength=4)
                    own = []
                    if base and key not in seen:
                        seen.add(key)
                        own = [hash64(w.encode()) for w in term_set(t, base)]
                    yield doc_id, key, *map(int, kinds), [{"k": k, "s": s, "e": e} for k, s, e in base], sorted(entities_of(t, base)), own

        yield from batches_of(rows(), schema)

    return materialize(docs.select("doc_id", "tkey", "text").mapInArrow(run, FOUND), "pii", texts=True)


def term_frequency(docs: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, n_t): distinct texts of the whole corpus that hold each of the terms asked for.

    Texts of one row are counted where they are; those that may have copies send their key along, once a task.
    """
    held, copied = bit_filter(asked, "t"), bit_filter(texts.where("rows > 1"), "tkey")
    ddl = "t long, n long, of long"
    schema = arrow_schema(ddl)

    def run(it):
        bits, twice = np.frombuffer(held, np.int64), np.frombuffer(copied, np.int64)

        def rows():
            once: dict[int, int] = {}
            seen: set[int] = set()
            for b in pieces(it):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for key, text, found in zip(b.column(0).to_pylist(), texts, wanted_terms(texts, bits)):
                    if not found or key in seen:
                        continue
                    own = set(found.values())
                    if base := base_spans(text):
                        own &= {hash64(w.encode()) for w in term_set(text, base)}
                    if in_filter(twice, key):
                        seen.add(key)
                        yield from ((h, 1, key) for h in own)
                    else:
                        for h in own:
                            once[h] = once.get(h, 0) + 1
                    if len(once) > HELD:
                        yield from ((h, n, None) for h, n in once.items())
                        once = {}
            yield from ((h, n, None) for h, n in once.items())

        yield from batches_of(rows(), schema, 65536)

    counts = materialize(docs.select("tkey", "text").mapInArrow(run, ddl), "counts", texts=True)
    once = counts.where("of is null").select("t", "n")
    copies = counts.where("of is not null").select("t", "of").distinct().select("t", F.lit(1).cast("long").alias("n"))
    return once.unionByName(copies).groupBy("t").agg(F.sum("n").alias("n_t")).join(asked, "t", "left_semi")


def disclosures(docs: DataFrame, *, support: int = 3, sigmas: float = 3.0, generalise: float = 0.7, remove: float = 0.95) -> DataFrame:
    """One row per document: base spans and disclosing terms, each as an array of (kind, start, end, action)."""
    source = with_key(docs.select(F.col("doc_id").cast("long"), "text"))
    texts = materialize(source.groupBy("tkey").agg(F.count("*").alias("rows")), "texts")
    total = float(max(1, texts.count()))
    found = scanned(source)
    holds = found.select("tkey", F.explode("entities").alias("c")).distinct()
    n_c = materialize(holds.groupBy("c").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= support), "entities")
    held = materialize(found.where("size(terms) > 0").select("tkey", F.explode("terms").alias("t")).distinct(), "terms")
    asked = materialize(held.groupBy("t").agg(F.count("*").alias("n_h")).where(F.col("n_h") >= support).select("t"), "asked")
    # n_ct is at most n_c: a term in more texts than this reaches `generalise` with no entity of so many texts.
    most = F.lit(total ** (1 - generalise)) * F.col("n_c").cast("double") ** F.lit(generalise) * (1 + 1e-9)
    top = n_c.agg(F.max(most)).first()[0] or 0.0
    n_t = materialize(term_frequency(source, asked, texts).where(F.col("n_t") <= top), "frequency")
    pairs = held.join(n_t, "t").join(holds.join(n_c, "c"), "tkey").where(F.col("n_t") <= most)
    pairs = pairs.groupBy("c", "t", "n_c", "n_t").agg(F.count("*").alias("n_ct"))
    chance = F.col("n_c") * F.col("n_t") / total
    pmi, ic = F.log(F.col("n_ct") / chance), F.log(F.lit(total) / F.col("n_c"))
    strong = pairs.where((F.col("n_ct") >= support) & (F.col("n_ct") >= chance + sigmas * F.sqrt(chance)))
    strong = strong.withColumn("share", F.when(ic > 0, pmi / ic)).where(F.col("share") >= generalise)
    strong = materialize(strong.groupBy("t").agg(F.max("share").alias("share")), "strong")
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")
    added = places_of(source, strong).join(strong, "t").groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("s", "e", action))).alias("terms"))
    added = materialize(added, "added", texts=True)
    release(texts, n_c, held, asked, n_t, strong)
    return found.drop("entities", "terms").join(added, "tkey", "left")


def places_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(tkey, t, s, e): where the texts of the whole corpus hold terms that may be among those asked for; of a task's copies one is read."""
    held = bit_filter(terms, "t")
    ddl = "tkey long, t long, s int, e int"
    schema = arrow_schema(ddl)

    def run(it):
        bits = np.frombuffer(held, np.int64)
        if not bits.any():
            return

        def rows():
            hits: set[int] = set()
            for b in pieces(it):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for key, text, found in zip(b.column(0).to_pylist(), texts, wanted_terms(texts, bits)):
                    if found and key not in hits:
                        hits.add(key)
                        places = [m.span() for m in TERM.finditer(text) if m.group() in found]
                        yield from ((key, found[text[s:e]], s, e) for s, e in outside(places, base_spans(text)))

        yield from batches_of(rows(), schema, 65536)

    return docs.select("tkey", "text").mapInArrow(run, ddl)


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with `text` sanitised: base spans and generalised terms become placeholders, removed terms go."""
    found = materialize(disclosures(docs, **options).select("tkey", "base", "terms").dropDuplicates(["tkey"]), "cuts")

    def mend(text, base, terms):
        cuts = [(x["s"], x["e"], f"[{KINDS[x['k']].upper()}]") for x in base]
        cuts += [(x["s"], x["e"], "" if x["action"] == "remove" else "[TERM]") for x in terms]
        out, at = [], 0
        for s, e, put in sorted(cuts):
            if s >= at:
                out += [text[at:s], put]
                at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def mended(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mend(t, b if b is not None else (), x if x is not None else ()) for t, b, x in zip(text, base, terms)])

    joined = with_key(docs, "__tkey").join(found.withColumnRenamed("tkey", "__tkey").withColumnRenamed("base", "__base").withColumnRenamed("terms", "__terms"), "__tkey", "left")
    return joined.withColumn("text", mended("text", "__base", "__terms")).select(*docs.columns)


def span_digests(found: DataFrame) -> DataFrame:
    """The digest columns of the query from the operator's spans."""

    def each(doc_id, tkey, n_email, n_ip, n_card, n_phone, base, terms):
        own = [(KINDS[x["k"]], x["s"], x["e"]) for x in base]
        more = [("term", x["s"], x["e"]) for x in terms or ()]
        yield doc_id, n_email, n_ip, n_card, n_phone, hashlib.sha256(digest(own).encode()).hexdigest(), digest(own + more), len(more)

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
    return map_rows(found.select("doc_id", "tkey", "n_email", "n_ip", "n_card", "n_phone", "base", "terms"), each, ddl)
