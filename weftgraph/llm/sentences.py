"""Sentences of mail bodies in many languages and scripts.

Bodies are cut into blocks. In spaced scripts the terminators of a block form a lattice: every span between two of them is a
possible sentence, with costs for the gaps it ends or bridges and for quotes and brackets it leaves open; the cheapest path
wins. Spaceless scripts are read by a word lattice over a dictionary of particles and of opening words that is counted over all
documents; final particles and opening words around an end mark decide whether the sentence goes on. Thai sentences are
separated by blanks. Which rules hold is told for each run of a script, not for the block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.mail import plain_body
from weftgraph.session import written

# Abbreviations after which a full stop ends no sentence, by what may follow.
#: before a name, whatever its case
TITLES = set("dr prof mr mrs ms st m mm sr sra srta dra д-р проф г-н г-жа د أ डॉ श्री".split())
#: before a number, a reference or a small letter; a capital after it begins a sentence
ABBREVIATIONS = set(
    "fig figs eq eqs no nos vol pp p ch sec vs ca approx e.g i.e etc al cf hrs min ext incl inc ltd co corp dept est a.m p.m u.s u.k "
    "abb nr bzw z.b d.h u.a usw evtl ggf bspw str tel vgl env art chap págs pág núm aprox p.ej fig rev "
    "см рис стр т.е т.д т.п г гг ок напр ул им млн млрд тыс".split()
)
#: never at the end of a sentence, even before a capital
INNER = set("e.g i.e fig eq no vol pp vs cf ca approx abb nr bzw z.b d.h vgl z env pág núm aprox p.ej см рис стр ок incl".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
#: verbs of speech that follow a quotation in scripts without capitals
REPORTING = ("سأل", "قال", "أجاب", "पूछा", "कहा", "बोला")
#: words that carry a sentence on after a closing quotation or an ellipsis
CONTINUERS = set("と って とい という などと だと の が は を に で も や 的 地 得 然后 但是 而且 所以 不过 可是 并且 因此 于是 接着".split())
#: particles that end a sentence before a mark
FINALS = set("か ね よ な わ ぞ です ます た だ 吗 呢 吧 了 啊 的 嘛".split())
END = ".!?…।॥؟۔。．！？｡"
OPENERS, CLOSERS = "([{«„“‘「『（【《〈", ")]}»”’」』）】》〉"
SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
THAI = re.compile(r"[฀-๿]")
#: A mark left open outweighs any number of stops.
SURE, OPEN_COST, ENUM_COST = 8.0, 1e9, 12.0
#: A dictionary word has at most so many characters and at least this share of the openings, which so many assumed ones are added to. By
#: its shares the dictionary has at most WORD_LENGTH / LEAST_SHARE words, however large the corpus.
WORD_LENGTH, LEAST_SHARE, ASSUMED = 6, 1 / 20_000, 90_000
#: Words between blanks that a run of a spaced script inside a spaceless one must have to be read by the lattice of terminators.
RUN_WORDS = 5


def blocks_of(body: str) -> list[str]:
    """Blocks of a decoded body: quoted lines dropped, ended by a signature or dashes, lines joined, white space single."""
    out: list[str] = []
    lines: list[str] = []
    for line in body.split("\n"):
        if line == "-- " or line.startswith("-----"):
            break
        if line.startswith(">"):
            continue
        if line.strip():
            lines.append(line)
        elif lines:
            out.append(" ".join(" ".join(lines).split()))
            lines = []
    if lines:
        out.append(" ".join(" ".join(lines).split()))
    return [b for b in out if b]


_GAP = re.compile(r"(\S*?)(\s?)([.!?…।॥؟۔]+)([\"'”“»’)\]}」』）]*)(?=\s+(\S+))")
_ENUMERATOR = re.compile(r"^(?:\(?(?:\d{1,3}|[a-zA-Z])[.)])+$")


def _gap_cost(word: str, mark: str, closers: str, following: str, rest: str, spaced: bool) -> tuple[float, float]:
    """Costs of ending a sentence here, and of going on."""
    ends, goes_on = (0.0, SURE), (SURE, 0.0)
    first = next((c for c in following if c.isalnum()), "")
    if spaced and not closers and following[:1] in "»”)" and len(following) <= 2:
        return goes_on  # French marks before a closing quote: "? »"
    opens_like_pH = len(following) > 1 and following[:1].islower() and any(c.isupper() for c in following[1:3])
    small = first.islower() and not opens_like_pH and following[:1] not in "([«“„"
    if small or following[:1] in ",;:—–-":
        return goes_on
    if closers and first and not first.isupper() and not first.isdigit() and any(rest.startswith(v) for v in REPORTING):
        return goes_on
    if set(mark) != {"."} or len(mark) > 1:
        if closers and mark[-1] in "?!؟" and _reported(rest):
            return goes_on
        return ends
    w = word.rsplit("(", 1)[-1].strip("«„“\"'¿¡([").casefold()
    if w in TITLES or (len(w) == 1 and w.isalpha() and word[-1:].isupper()):
        return goes_on
    if re.fullmatch(r"(?:\w\.)+\w", w) and w not in ("a.m", "p.m", "u.s", "u.k", "т.д", "т.п"):
        return goes_on
    if w in INNER or (len(w) == 1 and w.isalpha() and w not in "г" and not closers and not first.isdigit()):
        return goes_on
    if w in ABBREVIATIONS and not first.isupper():
        return goes_on if not opens_like_pH else (1.0, 2.0)
    if re.fullmatch(r"\d{1,2}", w) and following.strip(".,").casefold() in MONTHS:
        return goes_on
    return ends


def _reported(rest: str) -> bool:
    """Does a clause of speech follow a quotation, up to the next end mark?"""
    clause = re.split(r"[।؟!?.](?:\s|$)", rest, maxsplit=1)[0]
    return any(v in clause.split() for v in REPORTING)


_NO_MARK = re.compile(r"(?:(?<=\s)|^)\w{1,2}\)|[:;]-?[()]")
_OPEN_MARK = re.compile(r"[\"“”„«»()（）「」『』]")
#: what a mark adds to the balances of round, angle and the two kinds of corner brackets
_BALANCE = {"(": (0, 1), "（": (0, 1), ")": (0, -1), "）": (0, -1), "«": (1, 1), "»": (1, -1), "「": (2, 1), "」": (2, -1), "『": (3, 1), "』": (3, -1)}
State = tuple[int, int, int, int, int, int, int]


def _states(block: str, gaps: list[int]) -> list[tuple[int, State]]:
    """At each gap the German opening quotes so far, and the balances of brackets, German and curly quotes and the parity of
    straight quotes. Emoticons and enumerators like "a)" count for nothing; they hold no blank, so no gap lies in one."""
    skipped = {k for m in _NO_MARK.finditer(block) for k in range(m.start(), m.end())}
    marks = [(m.start(), m[0]) for m in _OPEN_MARK.finditer(block) if m.start() not in skipped]
    out, now, german, at, any_german = [], [0] * 7, 0, 0, "„" in block
    for g in gaps:
        while at < len(marks) and marks[at][0] < g:
            c = marks[at][1]
            if c in _BALANCE:
                k, d = _BALANCE[c]
                now[k] += d
            elif c == '"':
                now[4] ^= 1
            elif c == "„":
                german += 1
                now[5] += 1
            elif c == "“":
                now[5] -= any_german
                now[6] += 1
            else:
                now[6] -= 1
            at += 1
        out.append((german, tuple(now)))
    return out


def _open_marks(a: State, b: State, german: bool) -> int:
    """Quotes and brackets that a span from state ``a`` to ``b`` opens without closing or closes without opening; ``german``
    if it holds a German opening quote."""
    q = 5 if german else 6
    return abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) + (a[4] ^ b[4]) + abs(a[q] - b[q])


def spaced_sentences(block: str) -> list[str]:
    """Cheapest path through the lattice of terminators of a block in a spaced script."""
    gaps, costs = [0], [(0.0, 0.0)]
    for m in _GAP.finditer(block):
        costs.append(_gap_cost(m[1], m[3], m[4], m[5], block[m.start(5) :], bool(m[2]) or not m[1]))
        gaps.append(m.end())
    if len(gaps) == 1:
        return [block]
    if not re.search(r"[\"“”„«»()\[\]（）]", block):  # nothing can stay open: every gap stands alone, but for enumerators
        cut, out = 0, []
        for at, (end, on) in zip(gaps[1:], costs[1:], strict=True):
            if end < on and not _ENUMERATOR.match(block[cut:at].strip()):
                out.append(block[cut:at].strip())
                cut = at
        return [*out, block[cut:].strip()]
    gaps.append(len(block))
    costs.append((0.0, 0.0))
    # What a span costs beyond its ends depends on the states there only, so of the gaps in one state just the best is kept: the
    # work is in proportion to the gaps times the states, however long a span. Ties go to the shortest span.
    states = _states(block, gaps)
    back, before, bridged = [0] * len(gaps), 0.0, 0.0  # best cost up to the last gap; costs of going on at all gaps up to it
    with_german: dict[State, tuple[float, int]] = {}  # a German quote opens between these gaps and here
    without: dict[State, tuple[float, int]] = {}

    def keep(into: dict[State, tuple[float, int]], state: State, v: float, i: int) -> None:
        if state not in into or (v, -i) < (into[state][0], -into[state][1]):
            into[state] = v, i

    for j in range(1, len(gaps)):
        german, to = states[j]
        end = costs[j][0]
        least = before + end + OPEN_COST * _open_marks(states[j - 1][1], to, german > states[j - 1][0])
        if _ENUMERATOR.match(block[gaps[j - 1] : gaps[j]].strip()):  # a longer span holds a blank
            least += ENUM_COST
        at = j - 1
        if german > states[j - 1][0]:
            for state, (v, i) in without.items():
                keep(with_german, (*state[:6], 0), v, i)
            without = {}
        for group, quotes in ((without, False), (with_german, True)):
            for state, (v, i) in group.items():
                c = v + bridged + end + OPEN_COST * _open_marks(state, to, quotes)
                if (c, -i) < (least, -at):
                    least, at = c, i
        last = states[j - 1]
        if german > last[0]:
            keep(with_german, (*last[1][:6], 0), before - bridged, j - 1)
        else:
            keep(without, last[1], before - bridged, j - 1)
        back[j], before = at, least
        bridged += costs[j][1]
    cuts, j = [], len(gaps) - 1
    while j:
        cuts.append((gaps[back[j]], gaps[j]))
        j = back[j]
    return [s for a, b in reversed(cuts) if (s := block[a:b].strip())]


def lattice_words(text: str, dictionary: dict[str, float]) -> list[str]:
    """Most probable words of a spaceless text: the best path through all dictionary words, single characters as a way out."""
    n = len(text)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + WORD_LENGTH) + 1):
            p = dictionary.get(text[i:j])
            if p is None:
                if j > i + 1:
                    continue
                p = -14.0
            if best[i] + p > best[j]:
                best[j], back[j] = best[i] + p, i
    out, j = [], n
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


_CLOSING = r"([」』”’\"')）】》〉]*)"
_MARK = re.compile(rf"(?:[。．！？｡!?]+|…+|(?<=[぀-鿿])\.(?!\d)){_CLOSING}")
#: Between words of a spaced script only full-width marks, and those that follow a spaceless letter, end a sentence without a blank.
_WIDE_MARK = re.compile(rf"(?:[。．！？｡]+|(?<=[぀-鿿])(?:[!?]+|…+|\.(?!\d))){_CLOSING}")


def _depth(text: str) -> int:
    """Quotes and brackets still open at the end of a text."""
    return sum(text.count(o) - text.count(c) for o, c in ("「」", "『』", "“”", "（）", "()", "《》", "【】")) + text.count('"') % 2


def spaceless_sentences(block: str, dictionary: dict[str, float], marks: re.Pattern[str] = _MARK) -> list[str]:
    """Sentences of a Chinese or Japanese block: end marks outside quotations, unless the words around say that it goes on. Doubtful
    marks, after an ellipsis or a quotation, are decided by the word lattices of the sentence before and of the one after."""
    out, cut = [], 0
    for m in marks.finditer(block):
        if m.start() < cut:
            continue
        rest = block[m.end() :].lstrip()
        if not rest:
            break
        so_far = block[cut : m.end()]
        if _depth(so_far) > 0 or rest[0] in "，、；：,;:":
            continue
        ellipsis = block[m.start()] == "…"
        if m[1] or ellipsis:
            end = marks.search(rest)
            nxt = lattice_words(rest[: end.start()] if end and end.start() else rest, dictionary)
            if nxt[0] in CONTINUERS:
                continue
            if ellipsis and dictionary.get("\x00" + nxt[0], 0.0) < 0:
                before = lattice_words(re.sub(r"[^぀-鿿]+$", "", block[cut : m.start()]), dictionary)
                if not (before and before[-1] in FINALS):
                    continue
        out.append(so_far.strip())
        cut = m.end()
    tail = block[cut:].strip()
    return [*out, tail] if tail else out


_THAI_LETTERS, _SPACELESS_LETTERS = re.compile(r"[ก-๎]"), re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_SPACELESS_RUN = re.compile(r"[^぀-ヿ㐀-䶿一-鿿豈-﫿。．！？｡「」『』，、；：]+")


def thai_sentences(block: str) -> list[str]:
    """A blank ends a sentence beside a Thai word; runs of other words are read by the lattice of terminators."""
    out: list[str] = []
    run: list[str] = []
    for word in [*block.split(), "ก"]:
        if not THAI.search(word):
            run.append(word)
            continue
        if run:
            out += spaced_sentences(" ".join(run))
            run = []
        out.append(word)
    return out[:-1]


def sentences_of(block: str, dictionary: dict[str, float]) -> list[str]:
    """The sentences of a block, each run of it by the rules of its script."""
    thai, spaceless = len(_THAI_LETTERS.findall(block)), len(_SPACELESS_LETTERS.findall(block))
    if not thai and not spaceless:
        return spaced_sentences(block)
    others = sum(map(str.isalpha, block)) - thai - spaceless
    if thai > others + spaceless:
        return thai_sentences(block)
    if not spaceless:
        return spaced_sentences(block)
    if others > spaceless:  # a spaced script with some words of a spaceless one
        return [x for part in spaced_sentences(block) for x in (spaceless_sentences(part, dictionary, _WIDE_MARK) if SPACELESS.search(part) else [part])]
    out = []
    for part in spaceless_sentences(block, dictionary):
        cut = 0
        for run in _SPACELESS_RUN.finditer(part):
            if len(run[0].split()) >= RUN_WORDS and not _depth(part[: run.start()]):
                at = run.start()
                for piece in spaced_sentences(run[0])[:-1]:
                    at = part.index(piece, at) + len(piece)
                    out.append(part[cut:at].strip())
                    cut = at
        out.append(part[cut:].strip())
    return [x for x in out if x]


def mail_blocks(documents: DataFrame) -> DataFrame:
    """doc_id, block_no, block of every document with a plain body; null and empty texts have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = plain_body(text)
                if body:
                    b = blocks_of(body)
                    ids += [i] * len(b)
                    nos += range(len(b))
                    texts += b
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "block_no", "block"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(cut, "doc_id long, block_no int, block string")


def opening_words(blocks: DataFrame) -> DataFrame:
    """Counted dictionary of spaceless scripts, over all blocks: for the characters after each block start and end mark the
    words that begin there, with how often (n) and how often after an ellipsis or closing quotation (n_doubtful)."""
    spaceless = F.col("block").rlike(r"[぀-ヿ㐀-鿿]")
    starts = blocks.where(spaceless).select(F.explode(F.regexp_extract_all("block", F.lit(r"(^|[。！？!?…]+[」』”）)]*)\s*([぀-ヿ㐀-鿿]{1,6})"), F.lit(0))).alias("s"))
    parts = starts.select(F.regexp_extract("s", r"([぀-ヿ㐀-鿿]{1,6})$", 1).alias("w"), F.col("s").rlike(r"^(…|[。！？!?…]+[」』”）)])").cast("int").alias("doubtful"))
    counted = parts.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("doubtful").alias("n_doubtful"))
    prefixes = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda k: F.substring("w", F.lit(1), k))).alias("word"), "n", "n_doubtful")
    return prefixes.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_doubtful").alias("n_doubtful"))


def dictionary_rows(counts: DataFrame) -> DataFrame:
    """word, weight and doubtful of the counted words that are frequent enough, by shares alone, so that a corpus of any size is treated
    alike. The weight is the logarithm of the share, longer words gain by length as a prefix that always goes on in the same way is no
    word of its own; doubtful says that the word stands after doubtful gaps rather than sure ones."""
    total = counts.where("length(word) = 1").agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / (total + ASSUMED)
    rows = counts.select("word", F.when((F.length("word") > 1) & (share >= LEAST_SHARE), F.ln(F.col("n") / (total + 1.0)) - 2.0).alias("weight"), ((F.col("n_doubtful") + 1) / (F.col("n") + 4) > 0.5).alias("doubtful"), share.alias("share"))
    return rows.where((F.col("share") >= LEAST_SHARE) & (F.col("weight").isNotNull() | F.col("doubtful"))).drop("share")


def dictionary_of(rows: list[tuple[str, float | None, bool]]) -> dict[str, float]:
    """Log weights of words; under "\\x00" + word a negative entry says that the word is doubtful."""
    out: dict[str, float] = {}
    for word, weight, doubtful in rows:
        if weight is not None:
            out[word] = weight
        if doubtful:
            out["\x00" + word] = -1.0
    return out | dict.fromkeys(CONTINUERS | FINALS, -1.5)


def sentences(documents: DataFrame) -> DataFrame:
    """Distinct (doc_id, sentence) of the plain bodies of ``documents`` (doc_id, text; other columns are ignored).

    Messages that are null, empty or without a plain text part give no row. A block without end mark is one sentence;
    spans of any length are weighed. Repeated messages give their sentences under each doc_id.
    """
    blocks = written(mail_blocks(documents), "blocks")
    counts = written(opening_words(blocks), "openings")
    words = dictionary_of([tuple(r) for r in dictionary_rows(counts).collect()])  # at most WORD_LENGTH / LEAST_SHARE short words
    dictionary = blocks.sparkSession.sparkContext.broadcast(words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, block in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), strict=True):
                s = sentences_of(block, dictionary.value)
                ids += [i] * len(s)
                out += s
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "sentence"])

    return blocks.select("doc_id", "block").mapInArrow(cut, "doc_id long, sentence string").distinct()
