"""Plain-Python text rules that need Unicode normalisation or sequential state; wrapped as Arrow UDFs in udfs.py."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

# Devanagari letters and signs with their Latin readings. Consonants carry the inherent vowel.
VOWELS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ऋ": "ri", "ॠ": "rii", "ऌ": "li", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "ऍ": "e", "ऎ": "e", "ऑ": "o", "ऒ": "o",
}
VOWEL_SIGNS = {
    "ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "ृ": "ri", "ॄ": "rii", "ॢ": "li", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "ॅ": "e", "ॆ": "e", "ॉ": "o", "ॊ": "o",
}
CONSONANTS = {
    "क": "ka", "ख": "kha", "ग": "ga", "घ": "gha", "ङ": "nga", "च": "cha", "छ": "chha", "ज": "ja", "झ": "jha", "ञ": "nya",
    "ट": "ta", "ठ": "tha", "ड": "da", "ढ": "dha", "ण": "na", "त": "ta", "थ": "tha", "द": "da", "ध": "dha", "न": "na",
    "प": "pa", "फ": "pha", "ब": "ba", "भ": "bha", "म": "ma", "य": "ya", "र": "ra", "ल": "la", "व": "va", "श": "sha",
    "ष": "sha", "स": "sa", "ह": "ha", "ळ": "la",
    "क़": "ka", "ख़": "kha", "ग़": "ga", "ज़": "za", "ड़": "ra", "ढ़": "rha", "फ़": "fa", "य़": "ya",
}
OTHER_SIGNS = {
    "ं": "n", "ँ": "n", "ः": "h", "़": "", "ऽ": "", "्": "", "।": ".", "॥": ".", "ॐ": "om",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
VIRAMA = "्"
NUMBERS_EN = dict(zip(map(str, range(13)), "zero one two three four five six seven eight nine ten eleven twelve".split(), strict=True))
NUMBERS_HI = dict(zip(map(str, range(13)), "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह".split(), strict=True))
# Glue words that recall ignores, English and romanised Hindi.
GLUE = frozenset(
    """the a an is am are was were be been to of in on at for and or but so if it its this that these those i you he she
    we they me my your his her our their as with by from do did does has have had will would can could should not no yes ok
    hai hain tha thi the ho hota hoti hote ka ki ke ko kaa kii kee se me mein men par pe aur ya to bhi hi ye vo wo yah
    vah wah kya kyaa na nahi nahin naheen jo ek wala vala waala vaala raha rahi rahe gaya gayi gaye diya kar karna karne kiya tha""".split()
)
# Words that count as Hindi in Latin letters whatever a dictionary says.
ALWAYS_HINDI = frozenset(
    """hai hain hota hoti hote hua hui ka ke ki ko kaa mein se aur ya na bhi wo woh ye yeh kya kyu kyun kyunki nahi nahin haan
    yaar matlab accha acha theek thik bhai mujhe tujhe tumhe unhe unhein humein hum tum aap mera meri mere tera teri tere
    uska uski unka unke apna apni apne raha rahi rahe gaya gayi gaye diya kar karo karenge karna karne karta karti lagta
    lagti laga jaa jaana jaane chal chalo abhi kal aaj subah shaam raat ghar baat baar bahut bohot bhot zyada thoda sab
    kuchh koi kisi jis naya nayi naye purana purani wala wali waale waala sahi galat phir kaise kaisa kaisi kahan yahan
    wahan kaun agar warna lekin toh sirf haina honge unhone usne maine tune humne tumne kiya liya lekar dekho suno bola bolo""".split()
)
DEVANAGARI = "ऀ-ॿ꣠-ꣿ"

_DEVA_RUN = re.compile(f"[{DEVANAGARI}]+")
_SYLLABLE = re.compile("(" + "|".join(sorted(CONSONANTS, key=len, reverse=True)) + ")([" + "".join(VOWEL_SIGNS) + VIRAMA + "])?|(.)", re.S)
_SINGLE = VOWELS | VOWEL_SIGNS | OTHER_SIGNS


def romanise(text: str | None) -> str:
    """Latin reading of Devanagari; other characters pass."""

    def reading(m: re.Match) -> str:
        letter, mark, other = m.groups()
        if letter is None:
            return _SINGLE.get(other, other)
        stem = CONSONANTS[letter][:-1]
        return stem if mark == VIRAMA else stem + (VOWEL_SIGNS[mark] if mark else "a")

    return _DEVA_RUN.sub(lambda run: _SYLLABLE.sub(reading, run[0]), unicodedata.normalize("NFC", text or ""))


def drop_final_schwa(text: str) -> str:
    """Each word without its last a, if over two letters long with two vowels or more."""
    return " ".join([w[:-1] if w[-1] == "a" and len(w) > 2 and sum(map(w.count, "aeiou")) > 1 else w for w in text.split()])


def single_runs(text: str) -> str:
    """Runs of one character as one."""
    return re.sub(r"(.)\1+", r"\1", text)


def _single_runs_of_line(line: str) -> str:
    """`single_runs` of a text without line feeds, which those pass by."""
    code, kind = ("ascii", np.uint8) if line.isascii() else ("utf-32-le", np.uint32)
    units = np.frombuffer(line.encode(code, "surrogatepass"), kind)
    return units[np.diff(units, prepend=units[:1] + 1) != 0].tobytes().decode(code, "surrogatepass")


def compare_space(text: str | None) -> str:
    """The form in which spellings of one spoken word, in either script, agree."""
    text = text or ""
    if text.isascii():
        plain = drop_final_schwa(text).lower()
    else:
        latin = _DEVA_RUN.sub(lambda m: romanise(m[0]), unicodedata.normalize("NFC", text))
        plain = unicodedata.normalize("NFKD", drop_final_schwa(latin).lower())
        for mark in filter(unicodedata.combining, set(plain)):
            plain = plain.replace(mark, "")
    spelled = re.sub(r"\d+", lambda m: NUMBERS_EN[m[0]] if m[0] in NUMBERS_EN and int(m[0]) <= 10 else m[0], plain)
    return _single_runs_of_line(" ".join(re.sub(r"[^\w\s]", " ", spelled).split()).replace("w", "v"))


@functools.lru_cache(maxsize=1 << 17)
def phonetic(word: str) -> str:
    """A word with predictable differences between English and Hindi spelling folded."""
    folded = re.sub("c(?=[eiy])", "s", word.lower().replace("w", "v"))
    folded = re.sub("c(?!h)", "k", folded).replace("q", "k").replace("x", "ks").replace("ph", "f").replace("z", "j")
    return single_runs(folded)


@functools.lru_cache(maxsize=1 << 17)
def skeleton(word: str) -> str:
    return re.sub("[aeiou]+", "", phonetic(word))


def distance(a, b) -> int:
    """Levenshtein distance of two sequences, by Myers' bit vectors."""
    if not a or not b:
        return len(a) or len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diag = ((same & up) + up ^ up) | same | down
        more, less = down | ~(diag | up) & full, up & diag
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(diag | more) & full, more & diag
    return score


def closeness(a: str, b: str) -> float:
    return 1 - distance(a, b) / max(len(a), len(b), 1)


def _near(a: str, b: str, least: float) -> bool:
    """Whether two words are at least so close; lengths alone settle most pairs."""
    return 1 - abs(len(a) - len(b)) / max(len(a), len(b), 1) >= least and closeness(a, b) >= least


@functools.lru_cache(maxsize=1 << 17)
def same_word(a: str, b: str, least: float = 0.8) -> bool:
    """Whether two compare-space words agree plainly, phonetically or by their consonants."""
    if a == b or _near(a, b, least) or _near(phonetic(a), phonetic(b), least):
        return True
    x, y = skeleton(a), skeleton(b)
    return min(len(x), len(y)) > 1 and _near(x, y, least)


#: Words up to so long are found by letters left out, at most one of them; partners of longer ones have so many letters.
INDEXED, PARTNER = 9, 8


@functools.lru_cache(maxsize=1 << 13)
def _cuts(form: str) -> frozenset[str]:
    """A form and, from five letters, the form without any one of them."""
    return frozenset((form, *(form[:i] + form[i + 1 :] for i in range(len(form) if len(form) > 4 else 0))))


class Heard:
    """Words in which those that `same_word` takes for a given one are looked up.

    Forms within a fifth of the longer one's letters lose at most a fifth of their own on the way to what they share: none
    under five letters, one up to nine. So near forms of up to nine letters share a cut. Longer ones, whose partners have at
    least eight letters, are tried one by one. `same_word` decides in both cases.
    """

    def __init__(self, words: Iterable[str]):
        self.words = set(words)
        self.cut: list[dict[str, list[str]]] = [{}, {}, {}]
        self.long: list[list[str]] = [[], [], []]
        self.partners: list[list[str]] = [[], [], []]
        for h in self.words:
            for kind, form in self._forms(h):
                if len(form) > INDEXED:
                    self.long[kind].append(h)
                else:
                    for c in _cuts(form):
                        self.cut[kind].setdefault(c, []).append(h)
                if len(form) >= PARTNER:
                    self.partners[kind].append(h)

    @staticmethod
    def _forms(word: str) -> list[tuple[int, str]]:
        """Plain, phonetic and consonants; a single consonant tells nothing."""
        sound, bones = phonetic(word), skeleton(word)
        return [(0, word), (1, sound), *([(2, bones)] if len(bones) > 1 else [])]

    def _candidates(self, word: str) -> Iterator[str]:
        for kind, form in self._forms(word):
            if len(form) <= INDEXED:
                for c in _cuts(form):
                    yield from self.cut[kind].get(c, ())
            if len(form) >= PARTNER:
                yield from (self.partners if len(form) > INDEXED else self.long)[kind]

    def has(self, word: str) -> bool:
        return word in self.words or any(same_word(word, h) for h in self._candidates(word))


def looks_english(word: str) -> bool:
    return re.search("[fqxz]|(?:tion|ing|ment|able|ness|ful|phone|app)$", word) is not None


def weights(words: list[str], tags: list[str] | None) -> list[float]:
    """Two for English words and language switches; by the look of the word where tags don't fit."""
    if tags and len(words) == sum(t in ("hi", "en", "other") for t in tags):
        before = [None, *tags]
        return [2.0 if t == "en" or {t, p} == {"hi", "en"} else 1.0 for t, p in zip(tags, before, strict=False)][: len(words)]
    return [2.0 if looks_english(w) else 1.0 for w in words]


def _recall(want: list[str], got: list[str], tags: list[str] | None = None) -> float:
    """`recall` of compare-space words."""
    if not want or not got:
        return float(not want and not got)
    heard = Heard(got)
    known = {w: heard.has(w) for w in set(want) - GLUE}
    found = total = 0.0
    for w, weight in zip(want, weights(want, tags), strict=True):
        if w not in GLUE:
            total += weight
            found += weight * known[w]
    return found / total if total else 1.0


def recall(ref: str | None, hyp: str | None, tags: list[str] | None = None) -> float:
    """Weighted share of the reference's content words that the hypothesis has."""
    return _recall(compare_space(ref).split(), compare_space(hyp).split(), tags)


def _cer(want: list[str], got: list[str]) -> float:
    """`cer` of compare-space words."""
    r, h = ("".join(map(phonetic, x)) for x in (want, got))
    return distance(r, h) / len(r) if r else float(bool(h))


def cer(ref: str | None, hyp: str | None) -> float:
    """Character errors of phonetic forms without spaces."""
    return _cer(compare_space(ref).split(), compare_space(hyp).split())


def _cer_spaced(r: str, h: str) -> float:
    """`cer_spaced` of compare-space texts."""
    return distance(r, h) / len(r) if r else 1.0


def cer_spaced(ref: str | None, hyp: str | None) -> float:
    """Character errors of compare-space texts, spaces kept; an empty reference counts as wrong."""
    return _cer_spaced(compare_space(ref), compare_space(hyp))


def pair_scores(ref: str | None, hyp: str | None) -> tuple[float, float, float, float]:
    """recall, cer, wer and cer_spaced, with each text folded once."""
    r, h = compare_space(ref), compare_space(hyp)
    want, got = r.split(), h.split()
    return _recall(want, got), _cer(want, got), wer(ref, hyp), _cer_spaced(r, h)


def wer(ref: str | None, hyp: str | None) -> float:
    """Word errors without any folding; for diagnosis only."""
    r, h = (re.sub("[^\\w\\sऀ-ॿ]", " ", unicodedata.normalize("NFC", (x or "").lower())).split() for x in (ref, hyp))
    return distance(r, h) / len(r) if r else float(bool(h))


def similarity(text: str | None, ref: str | None) -> float:
    """Ratcliff-Obershelp similarity in compare space; 1 without a reference."""
    if not ref:
        return 1.0
    a, b = compare_space(romanise(text)), compare_space(ref)
    if a == b:  # one block
        return float(bool(a))
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _blocks_reach(a: str, b: str, least: float) -> bool:
    """Whether difflib's ratio is at least so much. Looks for matching blocks until those found or those still possible settle it."""
    enough = lambda matched: 2.0 * matched / (len(a) + len(b)) >= least
    found, most = 0, min(len(a), len(b))
    if not enough(most):
        return False
    matcher, open_ = difflib.SequenceMatcher(None, a, b), [(most, 0, len(a), 0, len(b))]
    while open_ and enough(most) and not enough(found):
        n, a0, a1, b0, b1 = open_.pop()
        i, j, size = matcher.find_longest_match(a0, a1, b0, b1)
        sides = [(min(i - a0, j - b0), a0, i, b0, j), (min(a1 - i, b1 - j) - size, i + size, a1, j + size, b1)] if size else []
        found += size
        most += size + sum(x[0] for x in sides) - n
        open_ += sorted(x for x in sides if x[0])
    return enough(found)


def similar(text: str | None, ref: str | None, least: float) -> bool:
    """Whether `similarity` is at least so much."""
    if not ref:
        return least <= 1.0
    latin = romanise(text)
    if latin == ref:  # one block, of some letter or digit in most cases
        return float(bool(re.search("[0-9A-Za-z]", ref) or compare_space(ref))) >= least
    a, b = compare_space(latin), compare_space(ref)
    return _blocks_reach(a, b, least) if a and b and a != b else float(bool(a) and a == b) >= least


#: English words among tokens between white space, as `columns.english_words` takes them.
_ENGLISH = re.compile(r"(?<!\S)[A-Za-z][A-Za-z'\-]*(?!\S)")


def english_words(text: str, stop: frozenset[str]) -> list[str]:
    """Plain Latin words in lower case, without stop words, without marks around them."""
    return [w.strip("'-") for w in " ".join(_ENGLISH.findall(text)).lower().split() if w not in stop]


@functools.lru_cache(maxsize=1 << 14)
def _one_off(word: str) -> tuple[frozenset[str], frozenset[str]]:
    """The word without any one letter, and with any one letter blank."""
    places = range(len(word))
    return frozenset(word[:i] + word[i + 1 :] for i in places), frozenset(word[:i] + " " + word[i + 1 :] for i in places)


@functools.lru_cache(maxsize=1 << 14)
def _letters(word: str) -> int:
    """Bits of the letters that occur, and of those that occur twice: an edit changes one at most on either side."""
    once = twice = 0
    for c in word:
        bit = 1 << (ord(c) & 31)
        twice |= once & bit
        once |= bit
    return once | twice << 32


#: Words under so many letters may be one edit off, and pairs that are compared at once.
ONE_EDIT, AT_ONCE = 8, 1 << 20


def heard_words(words: Iterable[str], heard: Iterable[str]) -> set[str]:
    """Those of the words that some heard word is, up to a quarter of their letters (one at least) and two in length.

    One edit is settled by look-ups: a letter less, a letter more, a letter blank. For more edits, letters settle most pairs.
    """
    heard = set(heard)
    words = set(words)
    found, rest = words & heard, words - heard
    short = {w for w in rest if len(w) < ONE_EDIT}
    if short:
        less, blank = set(), set()
        for h in heard:
            if len(h) <= ONE_EDIT:
                without, blanked = _one_off(h)
                less |= without
                blank |= blanked
        for w in short:
            without, blanked = _one_off(w)
            if w in less or not heard.isdisjoint(without) or not blank.isdisjoint(blanked):
                found.add(w)
    long, pool = sorted(rest - short), sorted((h for h in heard if len(h) >= ONE_EDIT - 2), key=len)
    if not long or not pool:
        return found
    marks = lambda words, mark: np.array([mark(w) for w in words], np.uint64)
    bits, size = marks(pool, _letters), np.array([len(h) for h in pool])
    step = max(1, AT_ONCE // len(pool))
    for at in range(0, len(long), step):
        part = long[at : at + step]
        own, n = marks(part, _letters)[:, None], np.array([len(w) for w in part])[:, None]
        most = n // 4
        near = (np.abs(size - n) <= 2) & (np.bitwise_count(own & ~bits) <= most) & (np.bitwise_count(bits & ~own) <= most)
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
            if part[i] not in found and distance(part[i], pool[j]) <= len(part[i]) // 4:
                found.add(part[i])
    return found


def english_recall(intended: str | None, heard: str | None, stop: frozenset[str]) -> float | None:
    """Share of the English words of a text that another one has; None where it has none. A missing text has no words."""
    words = english_words(intended or "", stop)
    if not words:
        return None
    known = heard_words(words, english_words(heard or "", stop))
    return sum(w in known for w in words) / len(words)


def spell_numbers(text: str | None) -> str:
    """Numbers up to twelve as words, in the script of their token; letters and digits apart."""
    out = []
    for token in (text or "").split():
        plain = token.translate({ord(k): v for k, v in OTHER_SIGNS.items() if v.isdigit()})
        if not re.search(r"\d", plain):
            out.append(token)
            continue
        names = NUMBERS_EN if re.search("[A-Za-z]", token) else NUMBERS_HI
        out += [names.get(p, p) for p in re.findall(r"\d+|\D+", plain)]
    return " ".join(out)


def bare(token: str) -> str:
    """A token without punctuation around it, and without dandas."""
    keep = f"\\w{DEVANAGARI[:3]}"
    return re.sub(f"^[^{keep}]+|[^{keep}]+$", "", re.sub(f"^[^{keep}]+|[^{keep}]+$", "", token).replace("।", "").replace("॥", ""))


def mixed_script(token: str) -> bool:
    body = bare(token)
    return bool(_DEVA_RUN.search(body) and re.search("[A-Za-z]", body))


def clean(text: str | None) -> str | None:
    """NFC, single spaces, numbers as words; None where a word mixes scripts or nothing is left."""
    out = spell_numbers(" ".join(unicodedata.normalize("NFC", text or "").split()))
    return out if out and not any(map(mixed_script, out.split())) else None


def repair(text: str | None) -> str:
    return " ".join(t for t in (text or "").split() if not mixed_script(t))


def _packed(units: list[str], fits: Callable[[str], bool]) -> list[str]:
    """Neighbours joined by spaces as long as they fit."""
    out: list[str] = []
    for u in filter(None, units):
        if out and fits(f"{out[-1]} {u}"):
            out[-1] = f"{out[-1]} {u}"
        else:
            out.append(u)
    return out


def clauses(text: str | None, most: int = 250) -> list[str]:
    """Chunks of up to `most` characters: by sentences, then commas, then words; an endless word is cut."""
    fits = lambda s: len(s) <= most
    text = (text or "").strip()
    if fits(text):
        return [text] if text else []

    def pieces(part: str, cuts: list[str]) -> list[str]:
        if fits(part):
            return [part]
        if cuts:
            return [x for p in _packed(re.split(cuts[0], part), fits) for x in pieces(p, cuts[1:])]
        out: list[str] = []
        run: list[str] = []
        for w in part.split():
            if fits(w):
                run.append(w)
            else:
                out += [*_packed(run, fits), *(w[i : i + most] for i in range(0, len(w), most))]
                run = []
        return out + _packed(run, fits)

    return [c for c in map(str.strip, pieces(text, [r"(?<=[।॥.!?])\s+", r"(?<=[,;:])\s+"])) if c]


_SENTENCE = re.compile(r"""(?:[^।!?\n.]|\.(?!\s|$))*(?:[।!?\n]|\.(?=\s|$)|$)(?:(?!\n)["'”’)\]\s])*""")


def sentences(text: str | None) -> list[str]:
    """Sentences with their final marks and closing quotes."""
    return [s for s in (m[0].strip() for m in _SENTENCE.finditer(text or "")) if s]


def token_chunks(text: str | None, most: int, count: Callable[[str], int] = lambda s: len(s.split())) -> list[str]:
    """Chunks within a token budget: sentences, else clauses, else words, packed greedily."""
    fits = lambda s: count(s) <= most
    units: list[str] = []
    for s in sentences(text):
        if fits(s):
            units.append(s)
            continue
        run: list[str] = []
        for c in filter(None, (x.strip() for x in re.split(r"(?<=[,;:،])\s+", s))):
            if fits(c):
                run.append(c)
            else:
                units += [*_packed(run, fits), *_packed(c.split(), fits)]
                run = []
        units += _packed(run, fits)
    return _packed(units, fits)


# Informal Roman spellings and their Devanagari, longest first where one begins another.
ROMAN_CONSONANTS = {
    "chh": "छ", "ksh": "क्ष", "shr": "श्र", "chr": "च्र", "sh": "श", "ch": "च", "th": "थ", "ph": "फ", "kh": "ख", "gh": "घ", "bh": "भ", "dh": "ध",
    "jh": "झ", "tt": "ट", "dd": "ड", "nn": "न", "ng": "ंग", "ny": "न्य", "gy": "ग्य", "tr": "त्र", "k": "क", "q": "क", "g": "ग", "j": "ज", "z": "ज़",
    "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ़",
    "c": "क", "x": "क्स",
}
ROMAN_VOWELS = {
    "aa": ("आ", "ा"), "ee": ("ई", "ी"), "ii": ("ई", "ी"), "oo": ("ऊ", "ू"), "uu": ("ऊ", "ू"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"),
    "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो"),
}
_ROMAN = re.compile(f"(?:({'|'.join(ROMAN_CONSONANTS)})({'|'.join(ROMAN_VOWELS)})?|({'|'.join(ROMAN_VOWELS)}))|(.)", re.S)


def devanagari(word: str) -> str:
    """Devanagari for a Roman spelling, by rule."""
    out, dead = "", False
    for consonant, sign, vowel, other in _ROMAN.findall(word.lower()):
        if consonant:
            out += (VIRAMA if dead else "") + ROMAN_CONSONANTS[consonant] + (ROMAN_VOWELS[sign][1] if sign else "")
            dead = not sign
        else:
            out += ROMAN_VOWELS[vowel][0] if vowel else other
            dead = False
    return out


_WORD = re.compile("[A-Za-zऀ-ॿ]+(?:['’\\-][A-Za-zऀ-ॿ]+)*")


def spells_english(word: str) -> bool:
    return bool(re.search("tion|ing|ment|ous|que|wh|ck$|ed$|ly$", word) or (len(word) > 6 and re.search("[qwxf]", word)))


#: The labels of the normaliser's rules, in order of precedence, each with the language it gives (none: the
#: neighbours decide), and the labels of decided words.
LABELS = (
    ("already", "hi"), ("single", "en"), ("force", "hi"), ("name", "hi"), ("ambig", None), ("english", "en"), ("lexicon", "hi"), ("name?", "hi"), ("looks-en", "en"), ("rule", "hi"),
)
DECIDED = {"en": "ambig-en", "hi": "ambig-hi"}
#: Fixed value: words of up to so many letters are remembered with what was made of them.
KEPT = 64
#: How far a neighbour's vote reaches, and what the nearest weighs.
REACH, NEAREST = 2, 2


@dataclass(slots=True)
class Span:
    """A word of the text with its spelling in the result, its language and the rule that settled it."""

    source: str
    spelled: str
    language: str | None
    how: str


def _reading(how: str, word: str, first: bool, force: dict, names: dict, ambiguous: dict, english: set, lexicon: dict) -> str | None:
    """What a rule makes of a word, None where it doesn't apply."""
    low = word.lower()
    tables = {"force": force, "name": names, "ambig": ambiguous, "lexicon": lexicon}
    if how in tables:
        return tables[how].get(low)
    if how == "rule" or how == "name?":
        return devanagari(low) if how == "rule" or word[:1].isupper() and not first else None
    applies = _DEVA_RUN.search(word) if how == "already" else len(word) == 1 if how == "single" else low in english if how == "english" else spells_english(low)
    return word if applies else None


def _vote(spans: list[Span], at: int) -> int:
    """English neighbours less Hindi ones, nearer ones weighing more; words settled before count as settled."""
    total = 0
    for step in range(1, REACH + 1):
        for other in (at - step, at + step):
            if 0 <= other < len(spans):
                total += (NEAREST + 1 - step) * {"en": 1, "hi": -1}.get(spans[other].language, 0)
    return total


def mixed_normaliser(force: dict, names: dict, ambiguous: dict, english: set, lexicon: dict) -> Callable[[str | None], tuple[str, list[Span]]]:
    """Romanised Hindi to Devanagari, English left; the spans. Doubtful words follow their neighbours. Short words are settled once."""

    def settle(word: str, first: bool) -> tuple[str, str | None, str]:
        for how, language in LABELS:
            spelled = _reading(how, word, first, force, names, ambiguous, english, lexicon)
            if spelled is not None:
                return spelled, language, how
        raise ValueError(word)  # the last rule takes any

    settled = functools.lru_cache(maxsize=1 << 15)(settle)

    def normalise(text: str | None) -> tuple[str, list[Span]]:
        text, spans = text or "", []
        for i, word in enumerate(_WORD.findall(text)):
            spans.append(Span(word, *(settled if len(word) <= KEPT else settle)(word, not i)))
        for i, span in enumerate(spans):
            if span.language is None:
                span.language = "en" if _vote(spans, i) > 0 else "hi"
                span.how = DECIDED[span.language]
                span.spelled = span.source if span.language == "en" else span.spelled
        spelled = (span.spelled for span in spans)
        return _WORD.sub(lambda _: next(spelled), text), spans

    return normalise


def mixed_normalise(text: str | None, force: dict, names: dict, ambiguous: dict, english: set, lexicon: dict) -> tuple[str, list[tuple[str, str, str]]]:
    """One text's normal form, with its spans as (source, language, how)."""
    out, spans = mixed_normaliser(force, names, ambiguous, english, lexicon)(text)
    return out, [(x.source, x.language, x.how) for x in spans]


def fnv_seed(base: int, key: str) -> int:
    """31-bit seed of a key: 64-bit FNV-1a, low bits, plus a base."""
    h = 1469598103934665603  # fixed value
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return base + (h & 0x7FFFFFFF) & 0x7FFFFFFF
