"""The language of texts and of their parts: nearest of several centroids for each language.

A stretch of text is a normalised TF-IDF vector of hashed character n-grams and is compared by cosine with the centroids that
clustering found in labelled texts. What is far from all of them has no language. Parts of one language are joined by the cheapest
sequence of languages along the text.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXTS_A_LANGUAGE = 200  # labelled texts from which the classifier is fitted, for each language; all texts are classified
LETTERS_A_TEXT = 2_500  # characters of a text used for fitting, in SLICES slices where it is longer
SLICES = 5
CENTROIDS = 6  # for each language
BUCKETS = 1 << 13
NEAREST = 0.2  # a cosine below this to all centroids is no language
STRETCH = 160  # characters of the longest stretch that is classified as one
SWITCH = 14.0  # what a change of language costs, in letters whose cosine differs by one
LEAST_LETTERS = 100  # of running text, for a language to count as one of the text's

# Usual spellings of language labels.
SPELLINGS = {
    "de": "de deu ger german deutsch allemand alemán alemao alemão tedesco duits niemiecki немецкий ドイツ語",
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels angielski английский 英語",
    "fr": "fr fra fre french französisch franzoesisch français francais francés francês francese frans francuski французский フランス語",
    "es": "es spa spanish spanisch espagnol español espanol espanhol spagnolo spaans hiszpański испанский スペイン語 castellano",
    "pt": "pt por portuguese portugiesisch portugais portugués português portugues portoghese portugees portugalski португальский ポルトガル語",
    "it": "it ita italian italienisch italien italiano italiaans włoski итальянский イタリア語",
    "nl": "nl nld dut dutch niederländisch niederlaendisch néerlandais neerlandés holandês olandese nederlands niderlandzki holenderski нидерландский голландский オランダ語",
    "pl": "pl pol polish polnisch polonais polaco polonês polacco pools polski польский ポーランド語",
    "ru": "ru rus russian russisch russe ruso russo rosyjski русский ロシア語",
    "ja": "ja jpn japanese japanisch japonais japonés japonês giapponese japans japoński японский 日本語",
}


def label_language(meta: str = "meta_data", key: str = "dc:language") -> Column:
    """The language that a record's label names (of a list, its first entry), by any usual spelling, with or without region; else null."""
    value = F.get_json_object(meta, f"$['{key}']")
    value = F.when(F.substring(value, 1, 1) == "[", F.get_json_object(meta, f"$['{key}'][0]")).otherwise(value)
    plain = F.regexp_replace(F.lower(F.trim(value)), r"[-_ (].*$", "")
    names = F.create_map(*[F.lit(x) for code, words in SPELLINGS.items() for w in words.split() for x in (w, code)])
    return F.try_element_at(names, plain)


_CUT = re.compile(r"(?<=[.!?…:;])\s+|\n+|(?<=[。！？])|\s*[|\t]\s*")


def stretches(text: str, most: int = STRETCH) -> list[tuple[int, int]]:
    """Sentences and lines of a text as (start, end), those longer than `most` cut at words. White space between belongs to none."""
    found, start = [], 0
    for m in [*_CUT.finditer(text), None]:
        end = m.start() if m else len(text)
        while end - start > most:
            at = text.rfind(" ", start + most // 2, start + most)
            at = start + most if at < 0 else at
            found.append((start, at))
            start = at
        if end > start:
            found.append((start, end))
        if m:
            start = m.end()
    return found


@lru_cache(1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first plane: whether it is a letter, and its lower case, a space where that is several characters."""
    letter, lower = np.zeros(0x10000, bool), np.arange(0x10000, dtype=np.int64)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            letter[code] = True
            lower[code] = ord(c.lower()) if len(c.lower()) == 1 else 32
    return letter, lower


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, everything but letters as one space; and the letters' own code points, 0 for what is none."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, lowers = _alphabet()
    near = np.minimum(raw, 0xFFFF)
    letter, lower = letters[near], lowers[near]
    far = np.flatnonzero(raw > 0xFFFF)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in raw[far]]
        lower[far] = [ord(low) if len(low := chr(c).lower()) == 1 else 32 for c in raw[far]]
    return np.where(letter, lower, 32), np.where(letter, raw, 0)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of n-grams of one to three characters and where each starts; n-grams of spaces alone, or with one inside, are left out."""
    padded = np.concatenate(([32], codes, [32, 32]))
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    h1, h2 = a * 0x9E3779B1 % 0xFFFFFFFB, (a * 0x9E3779B1 + b * 0x85EBCA6B) % 0xFFFFFFFB
    h3 = (h2 + c * 0xC2B2AE35) % 0xFFFFFFFB
    ones, twos, threes = np.flatnonzero(a != 32), np.flatnonzero((a != 32) | (b != 32)), np.flatnonzero((b != 32) & ((a != 32) | (c != 32)))
    at = np.concatenate((ones, twos, threes))
    return np.concatenate((h1[ones] % BUCKETS, (h2[twos] + 7) % BUCKETS, (h3[threes] + 13) % BUCKETS)), np.maximum(at - 1, 0)


def weighted(buckets: np.ndarray, owner: np.ndarray, idf: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF entries of `count` stretches, each normalised: stretch, bucket, value."""
    keys, n = np.unique(owner * BUCKETS + buckets, return_counts=True)
    rows, columns = keys // BUCKETS, keys % BUCKETS
    values = (1 + np.log(n)) * idf[columns]
    norms = np.sqrt(np.bincount(rows, weights=values**2, minlength=count))
    return rows, columns, values / np.maximum(norms[rows], 1e-12)


class Centroids:
    """Clustered centroids of languages in the space of TF-IDF n-grams."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        owners, buckets, of = [], [], []
        for k, language in enumerate(self.languages):
            for text in samples[language]:
                for a, b in stretches(text):
                    found, _ = grams(_codes(text[a:b])[0])
                    if len(found) >= 60:
                        buckets.append(found)
                        owners.append(np.full(len(found), len(of)))
                        of.append(k)
        self.idf = np.ones(BUCKETS)
        self.centroids = np.zeros((BUCKETS, 0), np.float32)
        self.of = np.zeros(0, np.int64)
        if not of:
            return
        count, of = len(of), np.array(of)
        buckets, owners = np.concatenate(buckets), np.concatenate(owners)
        documents = np.bincount(np.unique(owners * BUCKETS + buckets) % BUCKETS, minlength=BUCKETS)
        self.idf = np.log((1 + count) / (1 + documents)) + 1
        rows, columns, values = weighted(buckets, owners, self.idf, count)
        centroids, names = [], []
        starts = np.searchsorted(rows, np.arange(count + 1))
        for k in range(len(self.languages)):
            mine = np.flatnonzero(of == k)
            for c in _clusters(mine, starts, columns, values, CENTROIDS):
                centroids.append(c)
                names.append(k)
        self.centroids, self.of = np.stack(centroids, axis=1).astype(np.float32), np.array(names)

    def similarities(self, text: str, parts: list[tuple[int, int]], codes: np.ndarray | None = None) -> np.ndarray:
        """The cosine of each part to the nearest centroid of each language. codes: the text's, where they are at hand."""
        if not parts or not len(self.of):
            return np.zeros((len(parts), len(self.languages)))
        codes = _codes(text)[0] if codes is None else codes
        owner_at = np.full(len(codes), -1)
        for k, (a, b) in enumerate(parts):
            owner_at[a:b] = k
        buckets, at = grams(codes)
        owner = owner_at[np.minimum(at, len(codes) - 1)]
        buckets, owner = buckets[owner >= 0], owner[owner >= 0]
        rows, columns, values = weighted(buckets, owner, self.idf, len(parts))
        cosines = np.zeros((len(parts), len(self.of)), np.float32)
        for start in range(0, len(rows), 50_000):  # bounds the memory of a very long text
            r = rows[start : start + 50_000]
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            products = self.centroids[columns[start : start + 50_000]] * values[start : start + 50_000, None].astype(np.float32)
            cosines[r[first]] += np.add.reduceat(products, first, axis=0)
        return np.stack([cosines[:, self.of == k].max(1) if (self.of == k).any() else np.zeros(len(parts)) for k in range(len(self.languages))], axis=1)


def _clusters(mine: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, most: int, rounds: int = 6) -> list[np.ndarray]:
    """Spherical k-means over some stretches; the first centre is the mean, each further one the stretch farthest from those before."""
    if not len(mine):
        return []
    dense = np.zeros((len(mine), BUCKETS), np.float32)
    for i, m in enumerate(mine):
        dense[i, columns[starts[m] : starts[m + 1]]] = values[starts[m] : starts[m + 1]]
    centres = [dense.mean(0)]
    while len(centres) < min(most, len(mine)):
        near = (dense @ np.stack([c / max(np.linalg.norm(c), 1e-12) for c in centres], axis=1)).max(1)
        centres.append(dense[int(near.argmin())])
    centres = np.stack(centres)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = (dense @ centres.T).argmax(1)
        centres = np.stack([dense[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    sizes = np.bincount(nearest, minlength=len(centres))
    centres = centres[sizes >= max(1, 0.01 * len(mine))]  # a centre of a few stretches stands for those, not for the language
    return list(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12))


def _monotonous(letters: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which stretches, from first to last of a text's letters each, have 20 or more and are half of them one letter, as no language is."""
    many = last - first
    owner = np.repeat(np.arange(len(many)), many)
    keys, counts = np.unique(owner << 21 | letters[np.arange(len(owner)) + np.repeat(first - (np.cumsum(many) - many), many)], return_counts=True)
    most = np.zeros(len(many), np.int64)
    np.maximum.at(most, keys >> 21, counts)
    return (many >= 20) & (2 * most >= many)


def _sequence(gain: np.ndarray) -> list[int]:
    """The state of each stretch in the sequence that gains most, where each change of state costs SWITCH."""
    top = gain.argmax(1)[gain.any(1)]
    if len(top) and (top == top[0]).all():  # one state is best everywhere
        return [int(top[0])] * len(gain)
    best, back = gain[0], []
    for g in gain[1:]:
        at = int(best.argmax())
        stay = best >= best[at] - SWITCH
        back.append(np.where(stay, np.arange(len(g)), at))
        best = np.where(stay, best, best[at] - SWITCH) + g
    state = int(best.argmax())
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1]


def segments(model: Centroids, text: str | None) -> list[tuple[int, int, str, float, int]]:
    """Segments of one language each: (start, end, language, confidence, letters), in order.

    Stretches get the languages of the cheapest sequence, in which letters far from their language and changes of language cost.
    Stretches far from all languages, and those without letters, are in no segment unless one language surrounds them. confidence
    is 0.5 for a segment as near to the next language as to its own and grows towards 1.
    """
    if not text:
        return []
    parts = stretches(text)
    codes, own_letters = _codes(text)
    near = model.similarities(text, parts, codes)
    if not near.size:
        return []
    seen = np.concatenate(([0], np.cumsum(own_letters > 0)))
    only = own_letters[own_letters > 0]
    bounds = np.array(parts)
    first, last = seen[bounds[:, 0]], seen[bounds[:, 1]]
    near[_monotonous(only, first, last)] = 0
    letters = last - first
    languages = near.shape[1]
    states = _sequence(letters[:, None] * np.concatenate([near, np.full((len(parts), 1), NEAREST)], axis=1))  # the last state is no language
    found: list[tuple[int, int, str, float, int]] = []
    start = 0
    for k in range(1, len(parts) + 1):
        if k == len(parts) or states[k] != states[start]:
            own, many = states[start], letters[start:k]
            if own < languages and many.sum():
                mean = (near[start:k] * many[:, None]).sum(0) / many.sum()
                second = max((mean[j] for j in range(languages) if j != own), default=0.0)
                confidence = 1 / (1 + math.exp(-25 * float(mean[own] - second)))
                found.append((parts[start][0], parts[k - 1][1], model.languages[own], round(confidence, 4), int(many.sum())))
            start = k
    return found


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> Centroids:
    """A classifier from at most TEXTS_A_LANGUAGE distinct labelled texts of each language, drawn by hash among those with 200 characters or more.

    Of a text of more than LETTERS_A_TEXT characters, SLICES slices are used that are spread evenly over it.
    """
    rows = labelled.where(F.col(label).isin(*SPELLINGS) & (F.length(text) >= 200)).select(F.col(label).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    # Copies are drawn as one: their hashes are combined before they are shuffled, and the rank's bound keeps as many as are drawn in each task.
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    drawn = rows.select("_lang", "_hash").distinct().withColumn("_n", rank).where(F.col("_n") <= TEXTS_A_LANGUAGE).drop("_n")
    each = LETTERS_A_TEXT // SLICES
    length = F.length("_text")
    spread = [F.substring("_text", (F.lit(1) + F.floor((length - each) * i / (SLICES - 1))).cast("int"), F.lit(each)) for i in range(SLICES)]
    used = F.when(length <= LETTERS_A_TEXT, F.col("_text")).otherwise(F.concat_ws("\n", *spread))
    # A hash and a part of a text for each drawn one, TEXTS_A_LANGUAGE a language at most, are sent to the executors and reach the driver.
    found = rows.join(F.broadcast(drawn), ["_lang", "_hash"]).groupBy("_lang", "_hash").agg(F.min(used).alias("_text"))
    samples: dict[str, list[str]] = {}
    for r in found.collect():
        samples.setdefault(r["_lang"], []).append(r["_text"])
    for texts in samples.values():
        texts.sort()
    return Centroids(samples)


def language_segments(df: DataFrame, keys: list[str], text: str, model: Centroids) -> DataFrame:
    """keys, segment_no (from 1), start, end, lang, confidence, letters for each segment of each text; none for null and empty texts.

    The model, of a size fixed by the number of languages, CENTROIDS and BUCKETS, is sent to every executor. Texts stay in their rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def classified(batches):
        centroids = shared.value
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column("_text")):
                found = segments(centroids, value.as_py())
                rows += [row] * len(found)
                out += [(n, *s) for n, s in enumerate(found, 1)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(rows, pa.int64())).columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=[*keys, "segment_no", "start", "end", "lang", "confidence", "letters"])

    rows = df.select(*keys, df[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(classified, f"{schema}, segment_no int, start bigint, end bigint, lang string, confidence double, letters bigint")


def mislabelled(dbdoc: DataFrame, model: Centroids) -> DataFrame:
    """The languages of records whose label is missing or wrong or whose text mixes languages: id, lang, one row for each language.

    A language is in a text with a segment of LEAST_LETTERS letters or more; a text without any is no case.
    """
    labelled = dbdoc.select("id", "inhalt", label_language().alias("label"))
    found = language_segments(labelled, ["id", "label"], "inhalt", model).where(F.col("letters") >= LEAST_LETTERS)
    # A text's languages are as few as there are languages, so the set is small whatever the number of segments.
    by = found.groupBy("id", "label").agg(F.collect_set("lang").alias("langs"))
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return by.where(case).select("id", F.explode("langs").alias("lang"))
