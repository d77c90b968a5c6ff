"""Texts decoded with a wrong character encoding: found by a trained classifier, and restored.

A multinomial classifier over hashed byte bigrams names the chain of encodings that garbled a word. It is trained here: sound words
of the corpus are garbled by every chain. The chain named is inverted, and the word counts as garbled only if its bytes decode
strictly and garble into the same word again.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLED_TEXTS = 20_000  # texts whose words train the classifier; all texts are classified
WORDS = 12_000  # the most frequent words of the sample that are garbled for training
BUCKETS = 1 << 17
PRIOR = 0.002  # of all chains together, for a word
MARGIN = 6.0  # how much likelier, as a natural logarithm, a chain must be than that a word is sound
KNOWN_WORDS = 200_000  # decisions that a worker keeps

# The encodings that texts were written in, and those that they were taken for.
WRITTEN = "utf-8 cp1252 mac_roman cp437 cp850 cp1250 iso8859-2 cp852 cp1251 koi8-r cp866 mac_cyrillic shift_jis euc_jp".split()
TAKEN = "cp1252 latin-1 iso8859-15 cp1250 cp1251 cp437 cp850 mac_roman koi8-r cp866 iso8859-2".split()
_WORD = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f \t\r\n\f\v][^ \t\r\n\f\v]*")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_SPREAD = r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*"


def _table(encoding: str) -> tuple[dict[int, str], dict[str, int]]:
    """What each byte becomes in a one-byte encoding, and back; bytes it leaves undefined become the control character of their number."""
    forth = {}
    for b in range(256):
        try:
            forth[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            forth[b] = chr(b)
    back: dict[str, int] = {}
    for b, c in forth.items():
        back.setdefault(c, b)
    return forth, back


_TABLES = {e: _table(e) for e in TAKEN}
# Where a word whose whole is sound may be parted: punctuation that joins words without blanks.
_JOINT = re.compile("[!-/:-@\\[-`{-~–—―…·•|“”„«»‘’‚‹›。、，；：！？（）「」『』]+")


def chains() -> list[tuple[str, ...]]:
    """Every written encoding taken for another, and UTF-8 wrongly decoded twice. Each is (written, taken, written, taken ...)."""
    single = [(w, t) for w in WRITTEN for t in TAKEN if w != t and {w, t} not in ({"cp1252", "latin-1"}, {"cp1252", "iso8859-15"})]
    double = [("utf-8", a, "utf-8", b) for a, b in (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("cp850", "cp850"), ("cp437", "cp437"), ("mac_roman", "mac_roman"), ("cp1252", "cp1250"), ("cp1251", "cp1251"), ("cp1250", "cp1250"), ("iso8859-15", "iso8859-15"))]
    return single + double


def garble(text: str, chain: tuple[str, ...]) -> str | None:
    """text as it looks after the chain's wrong decodings; None if an encoding can't write it."""
    for written, taken in zip(chain[::2], chain[1::2], strict=True):
        try:
            data = text.encode(written)
        except UnicodeEncodeError:
            return None
        forth = _TABLES[taken][0]
        text = "".join(map(forth.__getitem__, data))
    return text


codecs.register_error("filequarry-lost", lambda e: (b"\x00", e.end))


def garble_all(words: list[str], chain: tuple[str, ...]) -> list[str | None]:
    """`garble` of each word, none of which holds a line break; as one text, which is many times as fast."""
    text = "\n".join(words)
    for written, taken in zip(chain[::2], chain[1::2], strict=True):
        text = text.encode(written, "filequarry-lost").decode("latin-1").translate(_TABLES[taken][0])
    return [None if "\x00" in spoilt else spoilt for spoilt in text.split("\n")] if words else []


def restore(text: str, chain: tuple[str, ...]) -> str | None:
    """The text before the chain's wrong decodings; None unless every step decodes strictly and leads back to the text."""
    plain = text
    for written, taken in zip(chain[-2::-2], chain[::-2], strict=True):
        back = _TABLES[taken][1]
        try:
            plain = bytes(map(back.__getitem__, plain)).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return plain if plain != text and garble(plain, chain) == text else None


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs of bytes next to and next but one to each other of which one at least is not ASCII, and where each begins."""
    buckets, starts = [], []
    for gap in (1, 2):
        a, b = data[:-gap].astype(np.int64), data[gap:].astype(np.int64)
        inside = (data[1:-1] != 10) if gap == 2 else True
        at = np.flatnonzero(((a > 127) | (b > 127)) & (a != 10) & (b != 10) & inside)
        buckets.append((a[at] * 0x9E3779B1 + b[at] * 0x85EBCA6B + gap * 0xC2B2AE35) % 0xFFFFFFFB % BUCKETS)
        starts.append(at)
    return np.concatenate(buckets), np.concatenate(starts)


_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def _bytes(words: list[str]) -> np.ndarray:
    """The words' bytes, each word between a mark for its start and one for its end, a line each. All digits are as one."""
    return np.frombuffer("".join(f"\x02{w}\x03\n" for w in words).encode("utf-8", "surrogatepass").translate(_DIGITS), np.uint8)


# A word's stretches of ASCII matter only next to other characters: the pattern and replacement of each cut.
_CUTS = ((r"\A[!-~]+([!-~]{2})", r"\1"), (r"([!-~]{2})[!-~]+\Z", r"\1"), (r"([!-~]{2})[!-~]*([!-~]{2})", r"\1 \2"), (r"[0-9]", "0"))


def fragments(word: str) -> list[str]:
    """The parts of a word around what isn't ASCII, with two ASCII characters at most on either side: between them no pair of bytes counts."""
    for pattern, kept in _CUTS:
        word = re.sub(pattern, kept, word)
    return [f for f in word.split(" ") if not f.isascii()]


class Classifier:
    """Multinomial naive Bayes over hashed byte bigrams: which chain garbled a word, or none."""

    def __init__(self, sound: dict[str, int], seen: dict[str, int] | None = None):
        """sound: fragments and their weights in the sample; seen: in how many of all texts each is, the same where it is left out."""
        self.sound = {w: (seen or sound).get(w, n) for w, n in sound.items() if n >= 3}
        words = sorted(sound)
        weight = np.array([float(sound[w]) for w in words])
        totals, self.chains = [], []
        for chain in (None, *chains()):
            spoilt = words if chain is None else garble_all(words, chain)
            kept = [i for i, (w, g) in enumerate(zip(words, spoilt, strict=True)) if g is not None and (chain is None or g != w)]
            if chain is None or kept:
                data = _bytes([spoilt[i] for i in kept])
                buckets, starts = _hashed(data)
                line = np.concatenate(([0], np.cumsum(data == 10)))[starts]
                totals.append(np.bincount(buckets, weights=weight[kept][line] if kept else None, minlength=BUCKETS))
                self.chains.append(chain)
        counts = np.stack(totals, axis=1)
        seen = np.flatnonzero(counts.sum(1))
        self.place = {int(f): i for i, f in enumerate(seen)}
        # All classes are measured against the sound words' total: a chain that can write few words has so much less weight. The last
        # row is for buckets never seen; they tell nothing between the classes.
        counts = np.vstack([counts[seen], np.zeros(counts.shape[1])]) + np.array([0.3 if c is None else 0.05 for c in self.chains])
        self.scores = np.log(counts / totals[0].sum().clip(1)).astype(np.float32)
        others = max(1, len(self.chains) - 1)
        self.prior = np.array([math.log(1 - PRIOR) if c is None else math.log(PRIOR / others) for c in self.chains], dtype=np.float32)

    def known(self, word: str) -> int:
        """In how many distinct texts the least frequent fragment of a word is seen; plain ASCII is seen everywhere."""
        return min((self.sound.get(f, 0) for f in fragments(word)), default=1 << 40)

    def likelihoods(self, word: str) -> np.ndarray:
        places = [self.place.get(f, -1) for f in _hashed(_bytes(fragments(word)))[0].tolist()]
        return self.scores[places].sum(0) + self.prior

    def verdict(self, word: str) -> tuple[float, str, tuple[str, ...]] | None:
        """margin, restored word and chain, if a chain is likelier than none by MARGIN and can be inverted strictly; else None.

        The chains are tried from the likeliest on. A restored word must itself be likeliest sound, and more so than the word was.
        """
        if not word:
            return None
        likely = self.likelihoods(word)
        for c in np.argsort(-likely):
            if c == 0 or likely[c] - likely[0] < MARGIN:
                break
            plain = restore(word, self.chains[c])
            if plain is None or not _readable(plain):
                continue
            # Exact check: a word that sound texts are seen to use is sound, unless what it would be restored to is used far more.
            used = self.known(plain)
            if self.known(word) * 2 > used:
                continue
            if not used and not plain.isascii():
                after = self.likelihoods(plain)
                if after[0] < after[1:].max() or after[0] < likely[0]:
                    continue
            return float(likely[c] - likely[0]), plain, self.chains[c]
        return None


def _readable(text: str) -> bool:
    return not any(0x7F <= ord(c) <= 0x9F or ord(c) < 9 or 0xE000 <= ord(c) <= 0xF8FF for c in text)


def _parts(texts: DataFrame, text: str) -> DataFrame:
    """text_hash and w: the fragments of each text's words, which may be repeated."""
    cut = F.col("w")
    for pattern, kept in _CUTS:
        cut = F.regexp_replace(cut, pattern.replace(r"\Z", r"\z"), kept.replace("\\", "$"))
    words = texts.select(F.xxhash64(text).alias("text_hash"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_SPREAD), F.lit(0)))).alias("w")).where(F.length("w") <= 200)
    return words.select("text_hash", F.explode(F.split(cut, " ")).alias("w")).where(F.col("w").rlike(r"[^\x00-\x7f]"))


def _sampled_share(documents: DataFrame, text: str) -> float:
    """The share of distinct texts that SAMPLED_TEXTS are, 1 at most."""
    total = documents.where(F.col(text).isNotNull()).agg(F.approx_count_distinct(F.xxhash64(text))).first()[0]
    return min(1.0, SAMPLED_TEXTS / max(1, total))


def sampled_words(documents: DataFrame, text: str = "text", share: float | None = None) -> dict[str, int]:
    """The most frequent fragments of words with other than ASCII characters, and in how many distinct texts, from about SAMPLED_TEXTS distinct texts at most, drawn by hash."""
    rows = documents.where(F.col(text).isNotNull())
    share = _sampled_share(documents, text) if share is None else share
    drawn = rows if share == 1 else rows.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(share * 1_000_000))
    counted = _parts(drawn, text).distinct().groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS).collect()  # WORDS fragments at most
    return {r["w"]: r["count"] for r in counted}


def seen_words(documents: DataFrame, parts: dict[str, int], text: str = "text") -> dict[str, int]:
    """In how many distinct texts of all documents each of these fragments is."""
    if not parts:
        return {}
    rows = documents.where(F.col(text).rlike(r"[^\x00-\x7f]"))
    names = sorted(parts)
    wanted = documents.sparkSession.createDataFrame(list(enumerate(names)), "n int, w string")
    pairs = _parts(rows, text).join(F.broadcast(wanted), "w").select("n", "text_hash").distinct()
    return {names[r["n"]]: r["count"] for r in pairs.groupBy("n").count().collect()}  # WORDS at most


def train(parts: dict[str, int], rounds: int = 2, seen: dict[str, int] | None = None) -> Classifier:
    """A classifier from fragments of which a small part is garbled: what can be inverted to a far more frequent one is left out, then what it finds itself.

    parts are the fragments of a sample, by which the classes are weighted; how frequent one is, is told by seen, which counts all texts.
    """
    seen = seen or parts
    sound: dict[str, int] = {}
    every = chains()
    for part, n in parts.items():
        if "\ufffd" in part:
            continue
        # A sequence of UTF-8 is one by accident so rarely that fragments holding nothing else beyond ASCII are never sound.
        multi = any(c[0] == "utf-8" and (p := restore(part, c)) is not None and _readable(p) for c in every)
        if not multi and not (len(part) > 2 and any(seen.get(restore(part, c) or "", 0) > 2 * seen.get(part, n) for c in every if c[0] != "utf-8")):
            sound[part] = n
    model = Classifier(sound, seen)
    for _ in range(rounds - 1):
        verdicts = {w: model.verdict(w) for w in sound}
        sound = {w: n for w, n in sound.items() if (v := verdicts[w]) is None or model.known(v[1]) < 2 * seen.get(w, n)}
        model = Classifier(sound, seen)
    return model


def _among(characters) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(characters)) + "]"


# For each encoding taken: a sequence as the first two bytes of a UTF-8 character give it, and the runs of its alphabet without white space.
_SEQUENCES = {t: re.compile(_among(f[b] for b in range(0xC2, 0xF5)) + _among(f[b] for b in range(0x80, 0xC0))) for t, (f, _) in _TABLES.items()}
_RUNS = {t: re.compile(_among(c for c in b if not c.isspace()) + "+") for t, (_, b) in _TABLES.items()}


@lru_cache(1 << 16)
def inner_spans(word: str) -> tuple[tuple[int, int, str | None], ...]:
    """Parts of a word that may have been decoded wrongly by themselves: (start, end, encoding it was taken for or None if any).

    First what stands between joining punctuation, then, for text without blanks, the longest runs that one encoding's alphabet can
    give and that hold what a UTF-8 character becomes in it. Parts of plain ASCII and the whole word are left out.
    """
    spans: list[tuple[int, int, str | None]] = []
    joints = [m.span() for m in _JOINT.finditer(word)]
    if any(0 < a and b < len(word) or not word[a:b].isascii() for a, b in joints):
        edges = [0, *[e for span in joints for e in span], len(word)]
        spans = [(a, b, None) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a and not word[a:b].isascii()]
    runs: list[tuple[int, int, str | None]] = []
    for taken, sequence in _SEQUENCES.items():
        if sequence.search(word):
            found = [m.span() for m in _RUNS[taken].finditer(word)]
            runs += [(a, b, taken) for a, b in found if b - a < len(word) and sequence.search(word, a, b)]
    return (*spans, *sorted(runs, key=lambda r: (r[0] - r[1], r[0])))


def _spots(word: str, verdict) -> list[tuple[int, int, tuple]]:
    """Where a word is garbled: (start, end, verdict), in order, none within another."""
    whole = verdict(word)
    if whole is not None:
        return [(0, len(word), whole)]
    found: list[tuple[int, int, tuple]] = []
    for a, b, taken in inner_spans(word):
        if all(b <= x or a >= y for x, y, _ in found):
            part = verdict(word[a:b])
            # A run is as long as its encoding's alphabet reaches, so only that encoding's chains, of several bytes a character, are meant.
            if part is not None and (taken is None or (part[2][-1] == taken and part[2][0] == "utf-8")):
                found.append((a, b, part))
    return sorted(found)


def mend(text: str, verdict) -> tuple[str, Counter, int] | None:
    """The restored text, how many words each chain had garbled, and how many lost characters stay lost; None for a sound text.

    A word, or a part of one between punctuation or other alphabets, is judged by the classifier. It is quoted as an example, and left
    alone, if what it would be restored to stands beside it.
    """
    chains_seen: Counter = Counter()
    lost = 0
    out, end = [], 0
    for m in _WORD.finditer(text):
        word = m.group()
        spots = _spots(word, verdict)
        # U+FFFD stands for what a decoder had to give up, unless it is named by itself between quotation marks.
        if not spots and "�" in word and not re.fullmatch(r"[\"'“”„«»‘’(]�+[\"'“”„«»‘’)][.,;:]?", word):
            lost += word.count("�")
        for a, b, (margin, plain, chain) in spots:
            first, last = m.start() + a, m.start() + b
            # A lone Cyrillic word in a text without any must be twice as sure.
            stray = margin < 2 * MARGIN and _CYRILLIC.search(plain) and not _CYRILLIC.search(text)
            if stray or _quoted(text, first, last, plain):
                continue
            chains_seen[chain] += 1
            out += [text[end:first], plain]
            end = last
    if not chains_seen and not lost:
        return None
    return "".join(out) + text[end:], chains_seen, lost


def _quoted(text: str, first: int, last: int, plain: str) -> bool:
    around = text[max(0, first - 2) : first] + " " + text[last : last + 2]
    return bool(re.search(r"[\"'“”„«»‘’]", around)) and len(plain) <= 6 and plain.strip("\"'“”„«»‘’.,") in text[last : last + 40]


def mended(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts that a wrong decoding changed: key, restored, chains (how they were garbled), words, lost (characters beyond recovery), found_by.

    found_by is 'classifier', 'replacement' for texts of which only U+FFFD tells that characters were lost, or 'both'.

    Null, empty and plain ASCII texts are sound. A text is looked at word by word, whole, in its row; the classifier, whose size is
    bounded by WORDS and the number of chains, is sent to every executor.
    """
    share = _sampled_share(documents, text)
    parts = sampled_words(documents, text, share)
    seen = parts if share == 1 else seen_words(documents, parts, text)  # a sample of all texts has counted them already
    model = documents.sparkSession.sparkContext.broadcast(train(parts, seen=seen))

    def checked(batches):
        classifier, known = model.value, {}

        def verdict(word: str):
            if word not in known:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[word] = classifier.verdict(word)
            return known[word]

        for batch in batches:
            rows, texts, names, words, losses, ways = [], [], [], [], [], []
            for row, value in enumerate(batch.column("_text").to_pylist()):
                found = mend(value, verdict)
                if found is not None:
                    rows.append(row)
                    texts.append(found[0])
                    names.append([" > ".join(c) for c, _ in found[1].most_common()])
                    words.append(sum(found[1].values()))
                    losses.append(found[2])
                    ways.append("replacement" if not found[1] else "both" if found[2] else "classifier")
            kinds = (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip((texts, names, words, losses, ways), kinds, strict=True)]
            taken = batch.column("_key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, *columns], names=[key, "restored", "chains", "words", "lost", "found_by"])

    suspects = documents.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = documents.schema[key].dataType.simpleString()
    return suspects.mapInArrow(checked, f"`{key}` {kind}, restored string, chains array<string>, words bigint, lost bigint, found_by string")
