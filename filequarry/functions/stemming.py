"""German stems after the published Snowball algorithm, for lower-case words."""

from __future__ import annotations

# Fixed values of the algorithm: vowels, and the letters that may stand before a removable s or st.
_VOWELS = frozenset("aeiouyäöü")
_BEFORE_S = frozenset("bdfghklmnrt")
_BEFORE_ST = frozenset("bdfghklmnt")
_UMLAUTS = str.maketrans("äöü", "aou")


def _region(word: str, start: int) -> int:
    """Where the part begins that follows the first non-vowel after a vowel, from start on."""
    for at in range(start + 1, len(word)):
        if word[at] not in _VOWELS and word[at - 1] in _VOWELS:
            return at + 1
    return len(word)


def _marked(word: str) -> str:
    """ß as ss, u and y between vowels in upper case, since they count as consonants there, and ae, oe, ue as umlauts (not after q)."""
    word = word.replace("ß", "ss")
    letters = list(word)
    for at in range(1, len(word) - 1):
        if word[at] in "uy" and word[at - 1] in _VOWELS and word[at + 1] in _VOWELS:
            letters[at] = word[at].upper()
    out, at = [], 0
    while at < len(letters):
        pair = "".join(letters[at : at + 2])
        if pair == "qu":
            out.append("qu")
            at += 2
        elif pair in ("ae", "oe", "ue"):
            out.append({"a": "ä", "o": "ö", "u": "ü"}[pair[0]])
            at += 2
        else:
            out.append(letters[at])
            at += 1
    return "".join(out)


def _ends(word: str, *endings: str) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a lower-case German word."""
    word = _marked(word)
    r1 = _region(word, 0)
    r2 = _region(word, r1)
    r1 = max(r1, 3)

    ending = _ends(word, "em", "ern", "er", "erin", "erinnen", "e", "en", "es", "s", "ln", "lns")
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending in ("em", "ern", "er", "erin", "erinnen"):
            if not (ending == "em" and base.endswith("syst")):
                word = base
        elif ending in ("e", "en", "es"):
            word = base
            if word.endswith("niss"):
                word = word[:-1]
        elif ending == "s":
            if base and base[-1] in _BEFORE_S:
                word = base
        else:
            word = base + "l"

    ending = _ends(word, "en", "er", "est", "st", "et")
    if ending and len(word) - len(ending) >= r1:
        base = word[: -len(ending)]
        if ending in ("en", "er", "est"):
            word = base
        elif ending == "st":
            if len(base) >= 4 and base[-1] in _BEFORE_ST:
                word = base
        elif len(base) >= 2 and not base.endswith(("geordn", "intern", "plan", "tick", "tr")):
            word = base

    ending = _ends(word, "end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")
    at = len(word) - len(ending)
    if ending and at >= r2:
        base = word[:at]
        if ending in ("end", "ung"):
            word = base
            if word.endswith("ig") and not word.endswith("eig") and len(word) - 2 >= r2:
                word = word[:-2]
        elif ending in ("ig", "ik", "isch"):
            if not base.endswith("e"):
                word = base
        else:
            word = base
            more = ("er", "en") if ending in ("lich", "heit") else ("lich", "ig")
            extra = _ends(word, *more)
            least = r1 if ending in ("lich", "heit") else r2
            if extra and len(word) - len(extra) >= least:
                word = word[: -len(extra)]
    return word.lower().translate(_UMLAUTS)
