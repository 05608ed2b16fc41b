"""One form for texts that look the same but are written with other characters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import written

# Characters without width that no general category tells: joiners, selectors, fillers.
WIDTHLESS = (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0, 0xFEFF)
WIDTHLESS_RANGES = ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
# Signs drawn like a common one, whatever stands beside them. Longer dashes and curved quotes are not.
DRAWN_LIKE = {"\u2010": "-", "\u2011": "-", "\u2212": "-", "\ufe63": "-", "\u2028": "\n", "\u2029": "\n"}
# Latin-1 and Latin Extended-A hold letters of living alphabets, which stand for themselves; the dotless i is drawn like i.
OWN_LETTERS, DOTLESS = range(0xC0, 0x180), 0x131
#: Letters are looked for up to here; beyond are ideographs.
LAST = 0x20000
#: Judged tokens that a process remembers from text to text.
MEMO = 100_000
_MARKS = "\u0300-\u036f\u0483-\u0487"
#: The rest of a run of letters with their marks.
RUN = re.compile(rf"(?:[^\W\d_][{_MARKS}]*)+")
#: Characters beyond the basic plane.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_IN_RUN = re.compile(rf"[^\W\d_]|[{_MARKS}]")


def script(ch: str) -> str:
    """The script of a letter, as the first word of its Unicode name."""
    return unicodedata.name(ch, "").partition(" ")[0]


def _rarity(c: int) -> tuple[int, int]:
    """ASCII, then the main letters of Cyrillic and Greek, then all others."""
    return (0 if c < 0x80 else 1 if 0x410 <= c < 0x450 else 2 if 0x391 <= c < 0x3CA else 3), c


@cache
def lookalikes(spark: SparkSession) -> dict[int, str]:
    """Letters outside ASCII -> the letter drawn alike that stands for them, from Unicode's confusables.

    The data are those of the ICU library that Spark itself brings (``SpoofChecker``), asked once on the driver. All
    letters of one skeleton are drawn alike; for them stands the ASCII letter of the same case (capital, where
    a script has no case), or the most common letter of the same case where there is none in ASCII. Letters of scripts
    with case are taken, and Lisu, which is drawn as Latin capitals.
    """
    letters = [c for c in range(0x41, LAST) if unicodedata.category(chr(c)) in ("Lu", "Ll") or script(chr(c)) == "LISU" and unicodedata.category(chr(c)) == "Lo"]
    letters = [c for c in letters if unicodedata.decomposition(chr(c)).partition(" ")[0] in ("", "<compat>")]  # others are folded
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join(map(chr, letters))).split("\n")
    classes: dict[str, list[int]] = {}
    for c, s in zip(letters, skeletons, strict=True):
        if len(s) == 1:
            classes.setdefault(s, []).append(c)
    table = {}
    for members in classes.values():
        by_case = {}
        for c in sorted(members, key=_rarity):
            by_case.setdefault("Ll" if unicodedata.category(chr(c)) == "Ll" else "Lu", c)
        for c in members:
            stands = by_case["Ll" if unicodedata.category(chr(c)) == "Ll" else "Lu"]
            if unicodedata.category(chr(c)) == "Lo" and stands >= 0x80:
                stands = min(members, key=_rarity)
            if c >= 0x80 and c != stands and (c not in OWN_LETTERS or c == DOTLESS):
                table[c] = chr(stands)
    return table


def _folds() -> dict[int, str]:
    """Wide, narrow and mathematical forms, ligatures, digraphs, number letters, dots, spaces and widthless characters,
    by Unicode's own tables."""
    table: dict[int, str] = {}
    for c in range(0x80, LAST):
        ch = chr(c)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        parts = [chr(int(x, 16)) for x in rest.split()] if kind == "<compat>" else []
        if kind in ("<wide>", "<narrow>", "<font>"):
            table[c] = unicodedata.normalize("NFKC", ch)
        elif parts and (0xFB00 <= c <= 0xFB4F or 0x2160 <= c <= 0x217F or len(parts) > 1 and all(x.isalpha() for x in parts) or all(x in "!?." for x in parts)):
            table[c] = "".join(parts)
        elif unicodedata.category(ch) == "Zs":
            table[c] = " "
    table |= {c: "" for lo, hi in WIDTHLESS_RANGES for c in range(lo, hi + 1)} | dict.fromkeys(WIDTHLESS, "")
    return table | {ord(k): v for k, v in DRAWN_LIKE.items()}


def compose(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class Reader:
    """Reads texts by a table of look-alike letters (``lookalikes``)."""

    def __init__(self, table: dict[int, str]) -> None:
        self.folds, self.stands = _folds(), {}
        self.memo: dict[str, tuple[str, str, bool, bool]] = {}
        self.home: dict[str, dict[int, str]] = {}
        first: dict[tuple[str, str], str] = {}
        for c, v in sorted(table.items(), key=lambda x: _rarity(x[0])):  # the common letters of a script first
            of = script(chr(c))
            one = v if script(v) == of else first.setdefault((v, of), chr(c))
            if one != chr(c):  # within a script there is nothing to judge
                self.folds[c] = one
            else:
                self.stands[c] = v
                self.home.setdefault(of, {})[ord(v)] = chr(c)
        self.script_of = {chr(c): script(chr(c)) for c in self.stands}
        #: Letters that stand for others: their own script does not tell where a token belongs.
        self.shared = set(self.stands.values())

    @cached_property
    def foreign(self) -> tuple[re.Pattern, re.Pattern]:
        """Letters of the scripts in question: a token with one of them is judged, as its Latin letters may be the wrong ones.
        For texts within the basic plane, whose class is a bitmap to the matcher, and for others."""
        return _classes(c for c in range(0x80, LAST) if script(chr(c)) in self.home and chr(c).isalpha())

    @cached_property
    def folded(self) -> tuple[re.Pattern, re.Pattern]:
        """Characters that are folded."""
        return _classes(self.folds)

    @cached_property
    def uneven(self) -> tuple[re.Pattern, re.Pattern]:
        """A text in composed form without any of these is in its one form already."""
        return _classes({*self.folds, *(c for c in range(0x80, LAST) if self.foreign[1].match(chr(c)))})

    def fold(self, text: str) -> str:
        """Wide forms, kinds of space and widthless characters set aside; accents in their decomposed form."""
        if text.isascii():
            return text
        folds = self.folds  # few characters of a text are folded, so they are looked for, not every character looked up
        return unicodedata.normalize("NFD", self.folded[ASTRAL.search(text) is not None].sub(lambda m: folds[ord(m[0])], text))

    def judge(self, token: str) -> tuple[str, str, bool, bool]:
        """(repaired, fallback, certain, mixed) of a folded token with letters of another script in it.

        Letters that no other script shares decide the token's script, else the script of most letters, Latin if
        equal. Letters from others are put into it: that is the repair. fallback is the token with the Latin, or
        most common, form of every look-alike. certain: the fallback is the form whatever the vocabulary says, as the token
        belongs to Latin, to several scripts or to look-alikes only, or its script lacks a letter.
        """
        fallback = token.translate(self.stands)
        scripts = Counter(self.script_of.get(c) or script(c) for c in token if c.isalpha())
        mixed = len(scripts) > 1
        decisive = {script(c) for c in token if c.isalpha() and c not in self.script_of and c not in self.shared}
        if len(decisive) == 1:
            home = next(iter(decisive))
        elif decisive:
            return fallback, fallback, True, mixed
        else:
            home = max(scripts, key=lambda s: (scripts[s], s == "LATIN"))
        if home == "LATIN" or home not in self.home:
            return fallback, fallback, True, mixed
        if not mixed:
            return (token, token, True, False) if decisive else (fallback, fallback, True, False)
        repaired = fallback.translate(self.home[home])
        if any(c.isalpha() and script(c) != home for c in repaired):
            return fallback, fallback, True, mixed
        return repaired, fallback, not decisive, True

    def runs(self, folded: str) -> Iterator[tuple[int, int]]:
        """Start and end of each run of letters that holds a letter of another script; linear in the text."""
        done, foreign = 0, self.foreign[ASTRAL.search(folded) is not None]
        while m := foreign.search(folded, done):
            start = m.start()
            while start > done and _IN_RUN.match(folded[start - 1]):
                start -= 1
            done = RUN.match(folded, m.start()).end()
            yield start, done

    def dissect(self, text: str, every: bool = False) -> tuple[list[str], list[dict], list[str]]:
        """(segments, open choices between them, words of the vocabulary) of one whole text. every: a token that the
        form changes is a choice also where its form is certain."""
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and not self.uneven[ASTRAL.search(text) is not None].search(text)):
            return [text], [], []
        folded = self.fold(text)
        segments, choices, words, done, here = [], [], set(), 0, []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for start, end in self.runs(folded):
            token = folded[start:end]
            if token not in memo:
                memo[token] = self.judge(token)
            repaired, fallback, certain, mixed = memo[token]
            here.append(folded[done:start])
            done = end
            if not mixed:  # written in one script other than Latin: a word repairs can aim at
                words.add(compose(token))
            if certain and not (every and fallback != token):
                here.append(fallback)
            else:
                segments.append(compose("".join(here)))
                here = []
                choices.append({"repaired": compose(repaired), "fallback": compose(fallback), "token": compose(token), "certain": certain, "mixed": mixed})
        here.append(folded[done:])
        segments.append(compose("".join(here)))
        return segments, choices, sorted(words)


def _classes(codes) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of one of these characters: of the basic plane only, and of all planes."""
    codes = sorted(codes)
    return re.compile(f"[{_spans([c for c in codes if c <= 0xFFFF])}]"), re.compile(f"[{_spans(codes)}]")


def _spans(codes: list[int]) -> str:
    """The inside of a character class."""
    out = []
    for i, c in enumerate(codes):
        if not i or c != codes[i - 1] + 1:
            out.append([c, c])
        out[-1][1] = c
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in out)


@cache
def reader(spark: SparkSession) -> Reader:
    """Made on the driver, once; workers get its tables and patterns."""
    made = Reader(lookalikes(spark))
    assert made.foreign and made.folded and made.uneven
    return made


_CHOICE = pa.struct([("repaired", pa.string()), ("fallback", pa.string()), ("token", pa.string()), ("certain", pa.bool_()), ("mixed", pa.bool_())])


def _dissect(batches: Iterator[pa.RecordBatch], schema: pa.Schema, read: Reader, every: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):  # a few texts at a time, whole, however long they are
            part = batch.slice(lo, 256)
            segments, choices, words = zip(*(read.dissect(t, every) for t in part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(segments, schema.field(2).type), pa.array(choices, schema.field(3).type), pa.array(words, schema.field(4).type)], schema=schema)


def canonical_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, raw_hash, form_hash[, form, repaired]): each text's one form and the 128-bit hashes of both.

    Texts have equal forms exactly when they read alike character by character once wide forms, characters
    without width, kinds of space, the order and composition of accents, ligatures and look-alike letters are set
    aside. Case, accents, digits and raised digits, other letters and word order stay.

    1. Each text is folded and its tokens with letters of other scripts are judged by the letters that only one
       script has (``Reader.judge``). ASCII texts pass through at once.
    2. Tokens of mixed script get their repair only when it occurs in the corpus vocabulary: words written in one
       script throughout. The distinct repairs in question are semi-joined with it; both are reduced by partial
       aggregation first, and neither goes to the driver.
    3. The texts in question are put together again. All others are finished after step 1.

    ``repaired`` is what this rule alone gives. It cannot make all texts equal that read alike: tokens of look-alikes
    only are of one script, and two disguises of a word that nobody wrote plainly have no vocabulary to go to.
    In ``form`` such tokens take the Latin, or most common, letter of each look-alike.

    doc_id must be an integer. Nulls: null and empty texts are no cases and get no row. A text of nothing but
    widthless characters has the empty form. Repeated texts get equal hashes, repeated ids a row each only if
    they are unique; an empty table gives no rows. Other columns are not read.
    """
    ddl = "doc_id bigint, raw_hash string, segments array<string>, choices array<struct<repaired:string,fallback:string,token:string,certain:boolean,mixed:boolean>>, words array<string>"
    schema = pa.schema([("doc_id", pa.int64()), ("raw_hash", pa.string()), ("segments", pa.list_(pa.string())), ("choices", pa.list_(_CHOICE)), ("words", pa.list_(pa.string()))])
    read = reader(documents.sparkSession)
    texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.md5(text).alias("raw_hash")).where("length(text) > 0")
    parts = texts.mapInArrow(lambda b: _dissect(b, schema, read, keep_text), ddl)
    whole = F.element_at("segments", 1)
    settled = F.size("choices") == 0
    kept = parts.select(
        "doc_id", "raw_hash", F.when(settled, F.md5(whole)).alias("form_hash"), *([F.when(settled, whole).alias("form")] if keep_text else []), F.when(~settled, F.col("segments")).alias("segments"), "choices", "words"
    )
    kept = written(kept, "dissected")
    open_texts = kept.where("form_hash is null")
    asked = open_texts.select("doc_id", F.posexplode("choices").alias("at", "choice")).select("doc_id", "at", "choice.*")
    wanted = asked.select("repaired").distinct()
    vocabulary = kept.select(F.explode("words").alias("repaired"))
    if keep_text:  # Latin words decide no form, but they do decide repairs
        plain = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}[\p{L}\p{Mn}]*)"), 1))).alias("repaired"))
        vocabulary = vocabulary.unionByName(plain.where(F.col("repaired").rlike(r"^[\p{IsLatin}\p{Mn}]+$")))
    known = vocabulary.distinct().join(wanted, "repaired", "left_semi").withColumn("known", F.lit(True))
    decided = asked.join(known, "repaired", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    word = F.when(~F.col("certain") & F.col("known"), F.col("repaired")).otherwise(F.col("fallback"))
    strict = F.when(F.col("mixed") & F.col("known"), F.col("repaired")).otherwise(F.col("token"))
    words = decided.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("word"), strict.alias("strict")))).alias("chosen"))
    joined = lambda c: F.expr(f"array_join(zip_with(segments, transform(chosen, x -> x.{c}), (s, c) -> concat(s, coalesce(c, ''))), '')")
    rebuilt = open_texts.drop("form").join(words, "doc_id").withColumn("form", joined("word")).withColumn("repaired", joined("strict")).withColumn("form_hash", F.md5("form"))
    columns = ["doc_id", "raw_hash", "form_hash", *(["form", "repaired"] if keep_text else [])]
    done = kept.where("form_hash is not null")
    done = done.withColumn("repaired", F.col("form")) if keep_text else done
    return done.select(columns).unionByName(rebuilt.select(columns))


def look_classes(forms: DataFrame) -> DataFrame:
    """(doc_id, class_id, texts): one row per document: the least document that looks like it, and how many different
    texts look so. Equal to all pairs of ``lookalike_pairs``, in as many rows as there are documents."""
    of_class = forms.groupBy("form_hash").agg(F.min("doc_id").alias("class_id"), F.countDistinct("raw_hash").alias("texts"))
    return forms.select("doc_id", "form_hash").join(of_class, "form_hash").select("doc_id", "class_id", "texts")


def lookalike_pairs(forms: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all pairs of texts with equal forms that are not equal as they stand.

    Copies of one text are one class. Classes of a form that has at least two are paired with each other, on
    the class table alone; only then do the documents of both classes meet. So the exact copies in a group,
    however many, are never compared with one another, and every joined row is a row of the result.
    """
    forms = written(forms.select("doc_id", "raw_hash", "form_hash"), "forms")
    several = forms.groupBy("form_hash").agg(F.min("raw_hash").alias("a"), F.max("raw_hash").alias("z")).where("a < z").select("form_hash")
    members = forms.join(several, "form_hash", "left_semi")
    classes = members.select("form_hash", "raw_hash").distinct()
    left = classes.select("form_hash", F.col("raw_hash").alias("raw_a"))
    right = classes.select("form_hash", F.col("raw_hash").alias("raw_b"))
    class_pairs = left.join(right, "form_hash").where("raw_a < raw_b")
    one = members.select("form_hash", F.col("raw_hash").alias("raw_a"), F.col("doc_id").alias("x"))
    two = members.select("form_hash", F.col("raw_hash").alias("raw_b"), F.col("doc_id").alias("y"))
    pairs = class_pairs.join(one, ["form_hash", "raw_a"]).join(two, ["form_hash", "raw_b"])
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
