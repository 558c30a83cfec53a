"""Subject areas of subtitle files by class-association rules.

Mine: the spoken cues of labelled documents are transactions of words and area tags; parallel frequent-pattern growth
finds the sets of words that go with a tag. Items are dealt to groups; a transaction goes to each of its items' groups,
cut after the last of them, and every group grows the patterns that end in its own items. Prune: a rule goes if fewer of
its words say the same about as surely, and a pattern is not grown where no longer one could be surer, or where a further
word changes nothing. Calibrate: the confidence of a rule, smoothed, is placed between what any cue has by chance and what
cues that surely deal with the area reach, since a label speaks of a document and not of each of its cues. Score: a cue
deals with the area of its strongest matching rule if that is likelier than not; an area holds for a document from a
quarter of its spoken cues on.

Mining takes two rounds, whatever the number of documents: all labelled ones first, then they and all others together, the
others with the areas that the rules of the first round find in them. Texts are read once; equal cues are mined as one row.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.llm.subtitles import spoken_words
from handloom.runtime import materialise, sendable

#: Cues that must hold the words of a rule and deal with its area.
LEAST_CUES = 3
LEAST_CONFIDENCE = 0.4
#: A word takes part if some area is so many times likelier with it than by chance.
LEAST_LIFT = 1.5
#: A longer rule must be surer than its part by this much.
GAIN = 0.05
#: Words of a rule. A rule needs GAIN on all of its parts, and the fourth word of a cue seldom gives it.
LONGEST = 3
#: Groups that the items of an area are dealt to, at least, and occurrences of items from which on there are more groups.
GROUPS = 64
GROUP_ROWS = 1_000_000
SHARE = 0.25


@dataclass(frozen=True)
class Rules:
    """Calibrated likelihood that a cue with these words deals with an area."""

    single: dict[str, tuple[str, float]]
    joint: dict[str, list[tuple[frozenset[str], str, float]]]

    def area_of(self, cue: list[str]) -> str | None:
        best, area, have = 0.5, None, set(cue)
        for w in cue:
            there = self.single.get(w)
            if there and there[1] > best:
                area, best = there
            for others, a, p in self.joint.get(w, ()):
                if p > best and others <= have:
                    best, area = p, a
        return area


def labelled(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, areas)`` of the labelled documents, without areas if their labels name none."""
    named = areas.select("subject").filter("subject is not null").distinct()
    known = labels.filter("doc_id is not null and subject is not null").join(
        sendable(named).withColumn("is_area", F.lit(True)), "subject", "left"
    )
    return known.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("is_area"), F.col("subject")))).alias("areas"))


def dialogue(docs: DataFrame) -> DataFrame:
    """``(doc_id, said)`` of every text: a line for each spoken cue, with its words between blanks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = ["".join(" ".join(cue) + "\n" for cue in spoken_words(text)) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string())], ["doc_id", "said"])

    return docs.select("doc_id", "text").filter("text is not null").mapInArrow(parse, "doc_id bigint, said string")


def _area_counts(rules: Rules, said: pa.Array) -> Iterator[tuple[Counter, int]]:
    """Cues of each area and all cues, of each text. Cues that were just met are not matched again."""
    area_of = lru_cache(1 << 16)(lambda cue: rules.area_of(cue.split()))
    for text in said.to_pylist():
        cues = text.split("\n")[:-1]
        yield Counter(filter(None, map(area_of, cues))), len(cues)


def weighed(uploads: DataFrame) -> DataFrame:
    """``(areas, words, n)`` of the spoken cues of ``uploads``, equal ones as one row."""
    lines = F.split(F.expr("substring(said, 1, length(said) - 1)"), "\n")  # the last one ends like the others
    each = uploads.filter("said <> ''").select("areas", F.explode(lines).alias("cue"))
    equal = each.groupBy("areas", "cue").agg(F.count(F.lit(1)).alias("n"))
    return equal.select("areas", F.filter(F.split("cue", " "), lambda w: w != "").alias("words"), "n")


Base = list[tuple[list[int], int, int]]


def grow(base: Base, n: int, p: float, room: int, single: list[float]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """``(words, n, k)`` of sets to join to a pattern, from ``base``: what stands before it in (words, cues, tagged cues).

    ``n`` and ``p`` are the pattern's cues and likelihood, ``single`` the likelihood of each word alone, ``room`` how many
    words may be added. Words that stand in all of the pattern's cues are passed over: they say nothing new, alone or
    with others, and long repeated cues consist of them. A set that is surer than its known parts by GAIN is given.
    """
    cues, tagged = Counter(), Counter()
    for words, m, k in base:
        for w in words:
            cues[w] += m
            if k:
                tagged[w] += k
    for w, k in tagged.items():
        m = cues[w]
        if k < LEAST_CUES or m == n:
            continue
        likely, part = k / (m + 1), max(p, single[w])
        if k >= LEAST_CONFIDENCE * m and likely > part + GAIN:
            yield (w,), m, k
        best = max(part, likely)
        if room > 1 and k / (k + 1) > best + GAIN:
            before = [(words[: words.index(w)], m, k) for words, m, k in base if w in words]
            for more, m2, k2 in grow([x for x in before if x[0]], m, best, room - 1, single):
                yield (*more, w), m2, k2


def mine(cues: DataFrame) -> tuple[list[tuple[frozenset[str], str, float, float]], dict[str, float]]:
    """Rules (words, area, confidence, cues with the words) and each area's share of all cues.

    A cue is one transaction for each area that some of its words tell of: those words, and whether its document has the
    area. Words of one area are thus mined with that area's tag alone, and sets of several tags never arise. The work for
    a cue grows with the cube of its telling words at most, LONGEST being 3. A column ``n`` says how often a cue counts.
    """
    if "n" not in cues.columns:
        cues = cues.withColumn("n", F.lit(1))
    n = cues.agg(F.sum("n")).first()[0]
    counted = cues.select(F.explode("areas").alias("area"), "n").groupBy("area").agg(F.sum("n").alias("n")).collect()
    chance = {r.area: r.n / n for r in counted}
    if not chance:
        return [], chance
    base = F.create_map(*(F.lit(x) for kv in chance.items() for x in kv))
    each = cues.select("areas", "n", F.explode("words").alias("word"))
    total = each.groupBy("word").agg(F.sum("n").alias("n"))
    by_area = each.select("word", "n", F.explode("areas").alias("area")).groupBy("word", "area").agg(F.sum("n").alias("k"))
    telling = by_area.join(total, "word").filter(
        (F.col("k") >= LEAST_CUES) & (F.col("k") / F.col("n") >= LEAST_LIFT * base[F.col("area")])
    )
    found = sorted(telling.collect(), key=lambda r: (-r.n, r.word, r.area))  # of the vocabulary, what tells of an area
    rules = [(frozenset([r.word]), r.area, r.k / r.n, float(r.n)) for r in found if r.k / r.n >= LEAST_CONFIDENCE]
    areas_of = defaultdict(dict)  # items are numbers, the most frequent first
    for i, r in enumerate(found):
        areas_of[r.word][r.area] = i
    groups = max(GROUPS, sum(r.n for r in found) // GROUP_ROWS)
    shared = cues.sparkSession.sparkContext.broadcast((dict(areas_of), [(r.n, r.k) for r in found]))

    def transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        areas_of, _ = shared.value
        for b in batches:
            out = []
            for have, words, m in zip(*(b.column(c).to_pylist() for c in ("areas", "words", "n")), strict=True):
                by = defaultdict(list)
                for w in words:
                    for a, i in areas_of.get(w, {}).items():
                        by[a].append(i)
                for a, items in by.items():
                    items.sort()
                    last = {i % groups: at for at, i in enumerate(items) if at}
                    out += [(a, g, items[: at + 1], m, m if a in have else 0) for g, at in last.items()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["area", "grp", "items", "n", "k"])

    def patterns(group: pa.Table) -> pa.Table:
        _, counts = shared.value
        single = [k / (n + 1) for n, k in counts]
        g, bases = group.column("grp")[0].as_py(), defaultdict(list)
        for items, m, k in zip(*(group.column(c).to_pylist() for c in ("items", "n", "k")), strict=True):
            for at, i in enumerate(items):
                if at and i % groups == g:
                    bases[i].append((items[:at], m, k))
        out = []
        for i, before in bases.items():
            n, k = counts[i]
            if k / (k + 1) > single[i] + GAIN:
                out += [([*w, i], m, k) for w, m, k in grow(before, n, single[i], LONGEST - 1, single)]
        area = pa.array([group.column("area")[0].as_py()] * len(out), pa.string())
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        kinds = [pa.list_(pa.int32()), pa.int64(), pa.int64()]
        return pa.table([area, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["area", "items", "n", "k"])

    dealt = cues.select("areas", "words", "n").mapInArrow(transactions, "area string, grp int, items array<int>, n bigint, k bigint")
    equal = dealt.groupBy("area", "grp", "items").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    joint = equal.groupBy("area", "grp").applyInArrow(patterns, "area string, items array<int>, n bigint, k bigint")
    rules += [(frozenset(found[i].word for i in r["items"]), r.area, r.k / r.n, float(r.n)) for r in joint.collect()]
    return rules, chance


def calibrate(mined, chance: dict[str, float]) -> Rules:
    """Prune redundant rules and turn confidence into likelihood."""
    sure: dict[tuple[frozenset[str], str], float] = {(w, a): (c * n) / (n + 1) for w, a, c, n in mined}
    kept = {
        (w, a): p
        for (w, a), p in sure.items()
        if not any(sure.get((frozenset(part), a), -1) >= p - GAIN for k in range(1, len(w)) for part in combinations(w, k))
    }
    weight = {(w, a): n for w, a, _, n in mined}
    reach = {}
    for area in chance:
        strong = sorted((p, weight[k]) for k, p in kept.items() if k[1] == area and p >= 2 * chance[area] and p > 0.5)
        reach[area] = sum(p * n for p, n in strong) / sum(n for _, n in strong) if strong else 1.0
    single: dict[str, tuple[str, float]] = {}
    joint = defaultdict(list)
    for (w, a), p in sorted(kept.items(), key=lambda x: (sorted(x[0][0]), x[0][1])):
        likely = min(1.0, max(0.0, (p - chance[a]) / max(reach[a] - chance[a], 1e-9)))
        if likely <= 0.5:
            continue
        if len(w) == 1:
            (word,) = w
            if word not in single or single[word][1] < likely:
                single[word] = (a, likely)
        else:
            joint[min(w)].append((w, a, likely))
    return Rules(single, dict(joint))


def learn(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> Rules:
    return learn_said(materialise(dialogue(docs), "dialogue"), labels, areas)


def learn_said(said: DataFrame, labels: DataFrame, areas: DataFrame) -> Rules:
    """Rules from all of ``said`` (what ``dialogue`` gives, read twice: pass it materialised). Uploads that say the same count once."""
    known = sendable(materialise(labelled(labels, areas), "labelled"))
    uploads = said.filter("doc_id is not null").join(known, "doc_id", "left").select("areas", "said").distinct()
    uploads = materialise(uploads, "uploads")
    cues = materialise(weighed(uploads.filter("areas is not null")), "cues")
    rules = calibrate(*mine(cues))
    if not rules.single and not rules.joint:
        return rules

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [sorted(a for a, k in counts.items() if k >= SHARE * n) for counts, n in _area_counts(rules, b.column("said"))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string())), b.column("said")], ["areas", "said"])

    others = uploads.filter("areas is null").mapInArrow(find, "areas array<string>, said string")
    return calibrate(*mine(materialise(cues.unionByName(weighed(others)), "cues")))


def area_shares(docs: DataFrame, rules: Rules) -> DataFrame:
    """``(doc_id, subject, n_cues, n_spoken)`` for every area that some spoken cue of a document deals with.

    * null and empty texts, texts without a spoken cue: no row; repeated documents: rows for each;
    * a cue repeated with its times: once; equal likelihoods: the first word by alphabet decides;
    * no labels: no rules, so no row; further columns are not carried on.
    """
    return shares_said(dialogue(docs), rules)


def shares_said(said: DataFrame, rules: Rules) -> DataFrame:
    """``area_shares`` of what ``dialogue`` gives."""
    spread = said.sparkSession.sparkContext.broadcast(rules)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, subject, hits, whole = [], [], [], []
            for i, (counts, n) in enumerate(_area_counts(spread.value, b.column("said"))):
                for a, k in counts.items():
                    at.append(i)
                    subject.append(a)
                    hits.append(k)
                    whole.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(subject, pa.string()), pa.array(hits, pa.int64()), pa.array(whole, pa.int64())],
                ["doc_id", "subject", "n_cues", "n_spoken"],
            )

    return said.mapInArrow(score, "doc_id bigint, subject string, n_cues bigint, n_spoken bigint")
