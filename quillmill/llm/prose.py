"""A word-class n-gram model of prose.

Text becomes a sequence of word classes: function words by kind, content words by case, numbers, links, tags, punctuation, and for
Han text function characters by kind and runs of other characters by length. Trigram counts over all prose-like lines of a corpus
give, per language, the expected loss of prose and its spread; a line's loss against them says how unlike prose it is.

The counts come from all rows; what reaches the driver is bounded by the alphabet (LANGS x CLASSES^3 cells at most).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of the five languages, by kind.
FUNCTION_WORDS = {
    "en": {
        "det": "a an the this that these those every each some any no all both another such its his her their our my your one",
        "prep": "of in on at by for with from to into over under after before against between without within across around near beside behind beyond about during through toward inside until since per than as",
        "conj": "and or but nor so because while when whether if although though where unless that which who whose what how why",
        "pron": "it he she they we you i him them us me nobody people someone everyone themselves itself there",
        "aux": "is are was were be been being has have had do does did can could will would shall should may might must cannot isn’t wasn’t don’t didn’t it’s that’s won’t",
        "adv": "not never only often rarely usually seldom nearly also even still just too very more most less least ever then once again instead",
    },
    "de": {
        "det": "der die das den dem des ein eine einen einem einer eines kein keine keinen dieser diese dieses jeder jede jedes alle einige sein seine ihr ihre unser unsere",
        "prep": "in im an am auf aus bei mit nach von vom zu zum zur über unter vor hinter neben zwischen durch für gegen ohne um seit bis während wegen laut trotz",
        "conj": "und oder aber denn sondern als wenn weil dass ob obwohl damit bevor nachdem sobald wie warum wer was wo",
        "pron": "er sie es wir ich du man ihm ihn ihnen uns sich niemand jemand",
        "aux": "ist sind war waren sein wird werden wurde wurden hat haben hatte hatten kann können konnte soll sollte muss müssen darf",
        "adv": "nicht nie nur oft selten auch noch schon sehr mehr kaum immer wieder dann so",
    },
    "fr": {
        "det": "le la les l un une des du ce cet cette ces chaque tout toute tous toutes aucun aucune son sa ses leur leurs notre nos votre vos mon ma mes",
        "prep": "de d à au aux en dans sur sous par pour avec sans contre entre vers chez dès depuis pendant après avant malgré selon",
        "conj": "et ou mais donc car ni que qu qui quand lorsque si comme parce puisque dont où pourquoi comment",
        "pron": "il elle ils elles on nous vous je tu se s y lui eux c n",
        "aux": "est sont était étaient être été a ont avait avaient peut peuvent doit doivent fait faire",
        "adv": "ne pas plus jamais très trop aussi encore souvent rarement ensuite presque toujours bien",
    },
    "es": {
        "det": "el la los las un una unos unas este esta estos estas ese esa cada todo toda todos todas ningún ninguna su sus nuestro nuestra mi tu",
        "prep": "de del a al en con sin por para sobre bajo contra entre hacia hasta desde durante tras según ante",
        "conj": "y e o u pero sino que cuando si como porque aunque donde mientras quien cuyo",
        "pron": "él ella ellos ellas nosotros yo se lo le les nos me te esto eso",
        "aux": "es son era eran ser sido fue fueron ha han había habían puede pueden debe está están",
        "adv": "no nunca muy más menos también ya casi siempre después luego entonces aún",
    },
}
# Chinese function characters, by kind.
HAN_FUNCTION = {
    "part": "的地得了着过吗呢吧啊",
    "prep": "在从到对把被将以向往由按据比跟给为于",
    "conj": "和与及或并且而却但因所如果虽若则",
    "pron": "我你您他她它们这那哪其此该每各某谁什么之",
    "aux": "是有没无会能可要让使",
    "adv": "不也就都很最再先后只又还更已曾正越当时中里上下",
}
LANGS = ("other", "zh", *FUNCTION_WORDS)
ZH = 1
_HAN_F = "".join(HAN_FUNCTION.values())


def _han_ranges() -> str:
    """U+4E00 to U+9FFF without the function characters, as ranges of a character class."""
    parts, start = [], 0x4E00
    for c in sorted(set(map(ord, _HAN_F))):
        if c > start:
            parts.append(f"{chr(start)}-{chr(c - 1)}")
        start = c + 1
    return "".join([*parts, f"{chr(start)}-鿿"])


TOKEN = re.compile(
    rf"\n|https?://\S+|www\.\S+|\[[^\]\n]*\]\([^)\n]*\)|#\w+|[{_HAN_F}]|[{_han_ranges()}]+|[^\W\d_一-鿿]+(?:['’-][^\W\d_一-鿿]+)*|\d+(?:[.,:/-]\d+)*|[^\w\s]|_+"
)
_NAMES = [
    "start", "eol", "link", "mdlink", "tag", "word", "cap", "upper", "num", "stop", "comma", "semi", "colon", "dash", "sep", "quote", "open", "close", "money", "mark",
    *(f"f_{k}" for k in ("det", "prep", "conj", "pron", "aux", "adv")), *(f"h_{k}" for k in HAN_FUNCTION), *(f"han{n}" for n in range(1, 9)), "hanlong",
]
CLASS = {n: i for i, n in enumerate(_NAMES)}
K = len(CLASS)
EOL, START = CLASS["eol"], CLASS["start"]
_PUNCT = {c: CLASS[k] for k, cs in {"stop": ".!?。！？", "comma": ",，、", "semi": ";；", "colon": ":：", "dash": "-–—", "sep": "/|·•»›>→*↑＊", "quote": "\"“”„«‹'’‘「」『』", "open": "([（【¿¡", "close": ")]）】", "money": "$€£¥￥%℃°"}.items() for c in cs}
_FUNCTION = {lang: {w: CLASS[f"f_{k}"] for k, ws in kinds.items() for w in ws.split()} for lang, kinds in FUNCTION_WORDS.items()}
_ANY: dict[str, int] = {}
_VOTES: dict[str, list[int]] = {}
for _lang, _words in _FUNCTION.items():
    for _w, _c in _words.items():
        _ANY.setdefault(_w, _c)
        _VOTES.setdefault(_w, []).append(LANGS.index(_lang))
_HAN_CLASS = {c: CLASS[f"h_{k}"] for k, cs in HAN_FUNCTION.items() for c in cs}
class _Classes(dict):
    """token -> class + 256 * vote; the vote is a bit mask of the languages that hold the function word. Filled as tokens come."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = out = _classify(token)
        return out


_memo = _Classes()


def _classify(token: str) -> int:
    first = token[0]
    if token == "\n":
        out = EOL, 0
    elif token.startswith(("http", "www.")):
        out = CLASS["link"], 0
    elif first == "[" and len(token) > 1:
        out = CLASS["mdlink"], 0
    elif first == "#" and len(token) > 1:
        out = CLASS["tag"], 0
    elif first in _HAN_CLASS:
        out = _HAN_CLASS[first], 2
    elif "一" <= first <= "鿿":
        out = CLASS[f"han{len(token)}" if len(token) < 9 else "hanlong"], 2
    elif first.isdigit() or first.isnumeric():
        out = CLASS["num"], 0
    elif first.isalpha():
        low = token.lower()
        # an elided article or pronoun belongs to the word that follows it
        head = re.split(r"['’]", low)[0]
        key = low if low in _ANY else ""
        if key:
            out = _ANY[key], sum(1 << v for v in _VOTES[key])
        else:
            vote = sum(1 << v for v in _VOTES.get(head, [])) if head != low and len(head) <= 2 else 0
            out = CLASS["upper" if token.isupper() and len(token) > 1 else "cap" if first.isupper() else "word"], vote
    else:
        out = _PUNCT.get(first, CLASS["mark"]), 0
    return out[0] + 256 * out[1]


#: For each vote, the languages in it.
_BITS = np.array([[(v >> i) & 1 for i in range(len(LANGS))] for v in range(1 << len(LANGS))])


@dataclass
class Lines:
    """Classes of one text with the first token of each line; the last line ends with an added line end."""

    tokens: list[str]
    classes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: int | np.ndarray  # of the text, or of each token where several texts are joined


def read_lines(text: str) -> Lines:
    tokens = TOKEN.findall(text)
    tokens.append("\n")
    codes = np.fromiter(map(_memo.__getitem__, tokens), np.int64, len(tokens))
    classes = codes & 255
    votes = np.bincount(codes >> 8, minlength=1 << len(LANGS)) @ _BITS
    votes[1] //= 2
    lang = int(votes.argmax()) if votes.max() > 0 else 0
    ends = np.flatnonzero(classes == EOL)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return Lines(tokens, classes, starts, ends, lang)


def trigrams(lines: Lines) -> np.ndarray:
    """Cell of each token in the table of its language; a line starts with two start classes."""
    c = lines.classes
    before = np.concatenate([[START], c[:-1]])
    before[lines.starts] = START
    before2 = np.concatenate([[START, START], c[:-2]])[: len(c)]
    before2[lines.starts] = START
    second = lines.starts + 1
    second = second[second <= lines.ends]
    before2[second] = START
    return ((lines.lang * K + before2) * K + before) * K + c


def is_prose_like(lines: Lines) -> np.ndarray:
    """Lines that the model learns from: long enough, ended as a sentence, with a share of function words."""
    c = lines.classes
    n = lines.ends - lines.starts
    cf, cc = np.concatenate([[0], IS_FUNCTION[c].cumsum()]), np.concatenate([[0], IS_CONTENT[c].cumsum()])
    f, w = cf[lines.ends] - cf[lines.starts], cc[lines.ends] - cc[lines.starts]
    last = c[np.maximum(lines.ends - 1, 0)]
    before_last = c[np.maximum(lines.ends - 2, 0)]
    ended = (last == CLASS["stop"]) | (((last == CLASS["quote"]) | (last == CLASS["close"])) & (before_last == CLASS["stop"]))
    return (n >= 12) & ended & (f >= 0.25 * w)


IS_FUNCTION = np.array([n[:2] in ("f_", "h_") for n in _NAMES], np.int32)
IS_CONTENT = np.array([n in ("word", "cap", "upper") or n.startswith("han") for n in _NAMES], np.int32)


#: Tokens of all languages' prose that each language's counts start from.
PRIOR_TOKENS = 2000


@dataclass
class ProseModel:
    """Loss in bits of each trigram cell, and mean and spread of the loss over the prose that it learned from, by language."""

    loss: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def line_losses(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Mean loss of each line and the number of its tokens (its end included)."""
        cum = np.concatenate([[0.0], np.cumsum(self.loss[trigrams(lines)], dtype=np.float64)])
        n = lines.ends - lines.starts + 1
        return (cum[lines.ends + 1] - cum[lines.starts]) / n, n

    def scores(self, lines: Lines) -> np.ndarray:
        """Standard errors by which a line's loss exceeds that of prose of its length."""
        loss, n = self.line_losses(lines)
        return (loss - self.mean[lines.lang]) / (self.spread[lines.lang] / np.sqrt(n))


def fit_rows(counts: DataFrame) -> ProseModel:
    """The model from partial (cell, n) counts."""
    rows = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return fit(np.array(rows.column("cell"), np.int64), np.array(rows.column("n"), np.int64))


def fit(cells: np.ndarray, counts: np.ndarray) -> ProseModel:
    """Interpolated trigram probabilities, from counts by cell."""
    langs = len(LANGS)
    c3 = np.zeros(langs * K**3)
    c3[cells] = counts
    c3 = c3.reshape(langs, K, K, K)
    c3[0] = c3.sum(axis=0)  # the unknown language holds what all hold
    # every other language starts from what all hold, at the weight of a fixed number of tokens
    c3[1:] += c3[0] * (PRIOR_TOKENS / max(1, c3[0].sum()))
    c2 = c3.sum(axis=1)
    c1 = c2.sum(axis=1)
    p1 = (c1 + 1) / (c1.sum(axis=1, keepdims=True) + K)
    p2 = (c2 + 4 * p1[:, None, :]) / (c2.sum(axis=2, keepdims=True) + 4)
    p3 = (c3 + 2 * p2[:, None, :, :]) / (c3.sum(axis=3, keepdims=True) + 2)
    loss = -np.log2(p3)
    total = np.maximum(c3.sum(axis=(1, 2, 3)), 1)
    mean = (c3 * loss).sum(axis=(1, 2, 3)) / total
    spread = np.sqrt(np.maximum((c3 * loss**2).sum(axis=(1, 2, 3)) / total - mean**2, 0.25))
    return ProseModel(loss.astype(np.float32).ravel(), mean, spread)
