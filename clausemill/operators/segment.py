"""Clause segmentation: documents to arrays of (text, label), by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions.text import clean_clause, is_html, strip, strip_html, word_count
from clausemill.operators.boundaries import Boundaries, joined
from clausemill.operators.rank import with_rank
from clausemill.plans.stages import exploded

LONG_PARAGRAPH, MIN_WORDS, MAX_WORDS, MAX_CLAUSES = 40, 10, 120, 120
# Fixed patterns
NUMBER_START = r"(?U)^\s*(\d+(\.\d+)*)\.\s+"
NUMBERED = r"(?mdU)(?:^|\s)(\d+(\.\d+)*)\.\s+(?=\S)"
BULLET = r"(?mdU)^\s*(-{1,2}|[*•→▪‣–])\s+(?=\S)"
LETTERED = r"(?U)(?:^|\n)\s*\([a-zA-Z]\)\s+(?=\S)"
EXHIBIT = r"(?mdU)^\s*[Ee][Xx][Hh][Ii][Bb][Ii][Tt]\s+[\dA-Z][\d\.]*\s*$"
INITIALS = r"(?iU)initials?\s*[_\-]{2,}"
DEFINITION = r"(?mdU)^\s*[\"“][A-Z][^\"”]{1,60}[\"”]\s+(means|shall mean|refers to|is defined as)"
SECTION = r"(?iU)(?:^|\n)\s*(Section|Article|Amendment|Clause|Schedule)\s+[\dIVXivx]+[\d\.]*"
LEGAL_WORDS = r"(?iU)\b(dispute|claim|controversy|violation|investigation|notice|request|demand|obligation|indemnif|terminat|arbitrat|liabilit|penalt|sancti|enforce|prohibit|restrict|disclos)\w*\b"
ONLINE_NUMBERED = r"(?U)(?:^|\n)\s*(\d{1,2}[\.)]\s+|\(?[a-z]\)\s+|[ivxlIVXL]+\.\s+)"
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"

CLAUSE = "struct<text:string,label:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _clause(text: Column, label) -> Column:
    return F.struct(text.alias("text"), (F.lit(label) if isinstance(label, str) else label).alias("label"))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def _labelled(parts: Column, label) -> Column:
    return F.transform(parts, lambda x: _clause(x, label(x) if callable(label) else label))


def paragraphs(text: Column, more_than: int = 0) -> Column:
    """Stripped paragraphs of more than so many words."""
    return F.filter(_parts(text, r"\n{2,}"), lambda p: word_count(p) > more_than)


def sentences(text: Column, model: Boundaries | None = None) -> Column:
    """Pieces after sentence marks; with learnt boundaries not those after abbreviations."""
    pieces = _parts(text, r"(?U)(?<=[.!?])\s+")
    return joined(pieces, model) if model else pieces


def _whole_or_sentences(p: Column, model: Boundaries | None, label: str = "paragraph", long_label: str = "spacy_sentence") -> Column:
    return F.when(word_count(p) > LONG_PARAGRAPH, _labelled(sentences(p, model), long_label)).otherwise(F.array(_clause(p, label)))


def numbered_paragraph(p: Column) -> Column:
    """Heading with bullets: one clause per bullet, prefixed by the heading so far; without bullets the whole."""

    def fold(lines: Column) -> Column:
        start = F.struct(strip(F.regexp_replace(lines[0], NUMBER_START, "")).alias("heading"), F.array().cast(f"array<{CLAUSE}>").alias("out"))

        def step(acc: Column, raw: Column) -> Column:
            def line_step(line: Column) -> Column:
                bullet = strip(F.regexp_replace(line, r"(?U)^[-•*→]\s+", ""))
                whole = F.when(acc["heading"] == "", bullet).otherwise(F.concat(acc["heading"], F.lit(": "), bullet))
                more = F.concat(acc["out"], F.array(_clause(whole, "semi_clause_bullet")))
                longer = F.when(line == "", acc["heading"]).otherwise(strip(F.concat(acc["heading"], F.lit(" "), line)))
                hit = line.rlike(BULLET.replace("^", r"\A"))
                return F.struct(F.when(hit, acc["heading"]).otherwise(longer).alias("heading"), F.when(hit, more).otherwise(acc["out"]).alias("out"))

            return _let(strip(raw), line_step)

        def finish(acc: Column) -> Column:
            return F.when(F.size(acc["out"]) > 0, acc["out"]).otherwise(F.array(_clause(acc["heading"], "numbered_clause")))

        return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), start, step, finish)

    return _let(F.split(p, LINES), fold)


def academic_hr(text: Column, model: Boundaries | None = None) -> Column:
    def one(p: Column) -> Column:
        bullets = F.split(p, BULLET)
        return F.when(p.rlike(NUMBER_START), numbered_paragraph(p)).when(F.size(bullets) > 1, _labelled(_parts(p, BULLET), "bullet_clause")).otherwise(_whole_or_sentences(p, model))

    return F.flatten(F.transform(paragraphs(text, 4), one))


def _numbered(text: Column) -> Column:
    return F.filter(_parts(text, NUMBERED), lambda x: ~x.rlike(r"(?U)^\d+(\.\d+)*$"))


def legal(text: Column, model: Boundaries | None = None) -> Column:
    def one(p: Column) -> Column:
        return (
            F.when(p.rlike(DEFINITION), F.array(_clause(p, "definition_clause")))
            .when(p.rlike(LETTERED), _labelled(_parts(p, LETTERED), "lettered_subclause"))
            .when(p.rlike(NUMBERED), _labelled(_numbered(p), "numbered_clause"))
            .otherwise(_whole_or_sentences(p, model))
        )

    text = F.regexp_replace(F.regexp_replace(text, EXHIBIT, ""), INITIALS, "")
    return F.flatten(F.transform(paragraphs(text, 3), one))


def privacy(text: Column, model: Boundaries | None = None) -> Column:
    def relabel(other):
        return lambda x: F.when(x.rlike(LEGAL_WORDS), F.lit("legal_keyword_clause")).otherwise(other)

    def one(p: Column) -> Column:
        label = relabel(F.lit("section_clause"))
        whole = F.when(word_count(p) > LONG_PARAGRAPH, F.transform(sentences(p, model), lambda s: _clause(s, label(p)))).otherwise(F.array(_clause(p, label(p))))
        return F.when(p.rlike(NUMBERED), _labelled(_numbered(p), relabel(F.lit("numbered_clause")))).otherwise(whole)

    def split(parts: Column) -> Column:
        flat = F.transform(academic_hr(text, model), lambda c: _clause(c["text"], relabel(c["label"])(c["text"])))
        return F.when(F.size(parts) <= 1, flat).otherwise(F.flatten(F.transform(F.filter(parts, lambda p: word_count(p) > 4), one)))

    # the split's capture (the word Section, Article, ...) counts as a part of its own
    parts = F.filter(F.flatten(F.transform(F.split(text, SECTION), lambda x: F.array(strip(x)))), lambda x: x != "")
    hits = F.regexp_count(text, F.lit(SECTION))
    return _let(F.when(hits > 0, F.concat(parts, F.array(F.lit("Section")))).otherwise(parts), split)


def by_domain(text: Column, domain: Column, model: Boundaries | None = None) -> Column:
    text = F.when(is_html(text), strip_html(text)).otherwise(text)
    return F.when(domain == "legal", legal(text, model)).when(domain == "privacy", privacy(text, model)).otherwise(academic_hr(text, model))


def online(text: Column) -> Column:
    """Clauses of pasted text: numbered or semicolon chunks of 8 to 150 words, longer ones by sentence."""

    def fits(x: Column) -> Column:
        return word_count(x).between(8, 150)

    def chunks(p: Column) -> Column:
        numbered = F.filter(_parts(p, ONLINE_NUMBERED), lambda x: ~x.rlike(r"(?U)^[\d\.)(\s]+$"))
        # a captured letter or roman marker is a chunk too, and so keeps the semicolon rule away
        lettered = p.rlike(r"(?U)(?:^|\n)\s*(\(?[a-z]\)\s+|[ivxlIVXL]+\.\s+)")
        return F.when(lettered | (F.size(numbered) > 1), numbered).otherwise(F.transform(F.split(p, r"(?U);\s+"), strip))

    def cut(raw: Column) -> Column:
        return _let(strip(F.regexp_replace(raw, r"(?U)\s+", " ")), lambda c: F.when(word_count(c) > 150, F.filter(sentences(c), fits)).when(fits(c), F.array(c)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(paragraphs(text), lambda p: F.flatten(F.transform(chunks(p), cut))))


def clauses(docs: DataFrame, cap: int = MAX_CLAUSES, model: Boundaries | None = None) -> DataFrame:
    """domain, source_doc, pos, raw_text, word_count, pattern_label of valid clauses, at most ``cap`` a document.

    docs has domain, source_doc and text; ``model`` has the learnt sentence boundaries, if any.  The cap counts valid clauses in document
    order and is taken inside the row, so nothing is shuffled.
    """
    found = F.transform(by_domain(F.coalesce("text", F.lit("")), F.coalesce("domain", F.lit("")), model), lambda c: _clause(clean_clause(c["text"]), c["label"]))
    valid = F.slice(F.filter(found, lambda c: word_count(c["text"]).between(MIN_WORDS, MAX_WORDS)), 1, cap)
    # a condition of the expression, not a filter: that would be computed, with all that the text is made of, before rows are dealt
    long_enough = F.length(strip(F.coalesce("text", F.lit("")))) >= 50
    rows = exploded(docs, ["domain", "source_doc"], F.when(long_enough, valid), "c", "pos")
    return rows.select("domain", "source_doc", "pos", F.col("c.text").alias("raw_text"), word_count(F.col("c.text")).alias("word_count"), F.col("c.label").alias("pattern_label"))


def numbered_ids(rows: DataFrame, order: list[str], width: int = 6, name: str = "clause_id") -> DataFrame:
    """Adds ids such as C000001 in the given order."""
    out = with_rank(rows, [F.col(c).asc() for c in order], "_number")
    return out.withColumn(name, F.format_string(f"C%0{width}d", "_number")).drop("_number")
