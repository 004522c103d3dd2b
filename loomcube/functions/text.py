"""Column expressions for text: counting, normalising, synonym variants, screening, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcube.storage import materialise

#: Last words that mark a species, and header names of article sections.
SPECIES = ("human", "pig", "mouse", "rat")
SECTION_HEADERS = ("introduction", "methods", "results", "discussion")
TAIL_HEADERS = ("abbreviations", "references", "refs")


def count_substring(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` that do not overlap; case matters, word bounds do not. An empty part counts 0."""
    times = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.nullif(F.length(part), F.lit(0))
    return F.coalesce(times, F.lit(0)).cast("long")


def run_starts(name: str, field: str | None = None) -> Column:
    """Where in the sorted array column ``name`` another value begins, from 0; of structs ``field`` counts."""
    at = (lambda i: F.get(name, i)[field]) if field else (lambda i: F.get(name, i))
    return F.filter(F.sequence(F.lit(0), F.size(name) - 1), lambda i: (i >= 0) & (i < F.size(name)) & ((i == 0) | (at(i) != at(i - 1))))


def runs(name: str, starts: str, made) -> Column:
    """``made(start, length)`` of every run of equal values of the array column ``name``; see :func:`run_starts`.

    So the words of a text are counted in its own row: work grows as its sort, and nothing is exchanged.
    """
    return F.transform(starts, lambda a, k: made(a, F.coalesce(F.get(starts, k + 1), F.size(name)) - a))


def normalise_hyphens(text: Column) -> Column:
    """Hyphens become blanks unless a blank follows; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, "-(?! )", " "))


def normalise_synonym(text: Column) -> Column:
    """As for documents, but a final hyphen stays."""
    return F.trim(F.regexp_replace(F.concat(text, F.lit(" ")), "-(?! )", " "))


def title_text(title: Column) -> Column:
    """Title padded with blanks, commas and colons blanked, lower case."""
    return F.lower(F.concat(F.lit(" "), F.translate(F.coalesce(title, F.lit("")), ",:", "  "), F.lit(" ")))


def without_species(synonym: Column) -> Column:
    """The first word of a synonym of two words whose second is a species, else null."""
    words = F.split(synonym, " ")
    return F.when((F.size(words) == 2) & F.element_at(words, -1).isin(*SPECIES), F.element_at(words, 1))


def case_tokens(synonym: Column) -> Column:
    """Words of a synonym, a hyphen standing as a word of its own and a slash ending one."""
    return F.split(F.replace(F.replace(synonym, F.lit("-"), F.lit(" - ")), F.lit("/"), F.lit("/ ")), " ")


def _spellings(word: Column) -> Column:
    """The word in lower case and capitalised, if it varies: letters only, lower case or capitalised; one capital alone does not."""
    varies = F.replace(word, F.lit("/"), F.lit("")).rlike(r"^\p{Lu}?\p{Ll}+$")
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))
    return F.when(varies, F.array(F.lower(word), capital)).otherwise(F.array(word))


def _rejoined(words: Column) -> Column:
    return F.replace(F.replace(words, F.lit(" - "), F.lit("-")), F.lit("/ "), F.lit("/"))


def case_variants(synonym: Column) -> Column:
    """All spellings with each plain word in lower case or capitalised, as a list: for names of few words.

    :func:`vary_case` gives the same as rows, whatever the number of words.
    """
    joined = F.aggregate(
        case_tokens(synonym), F.array(F.lit("")),
        lambda acc, word: F.flatten(F.transform(acc, lambda head: F.transform(_spellings(word), lambda w: F.concat(head, F.lit(" "), w)))),
    )
    return F.array_distinct(F.transform(joined, lambda s: _rejoined(F.substring(s, 2, 1 << 20))))


def vary_case(names: DataFrame, column: str, variant: str = "variant") -> DataFrame:
    """A row with each spelling of :func:`case_variants` for every row of ``names``; names without letters keep one.

    Words are taken one at a time, so a name of k plain words gives 2 ** k rows without a list of them in any row.
    """
    out = names.withColumns({"__words": case_tokens(F.col(column)), "__done": F.lit("")})
    most = out.agg(F.max(F.size("__words")).alias("n")).first()["n"] or 0
    for i in range(most):
        word = F.get("__words", F.lit(i))
        step = F.when(word.isNull(), F.array(F.lit(""))).otherwise(F.transform(_spellings(word), lambda w: F.concat(F.lit(" "), w)))
        out = out.withColumn("__next", F.explode(step)).withColumn("__done", F.concat("__done", "__next")).drop("__next")
    return out.withColumn(variant, _rejoined(F.substring("__done", 2, 1 << 20))).drop("__words", "__done").distinct()


def comma_permutations(term: Column) -> Column:
    """All orders of the parts of ``A, B, C`` joined by blanks, as a sorted list: for terms of few parts.

    :func:`permute_commas` gives the same as rows, whatever the number of parts.
    """
    parts = F.transform(F.split(term, ","), lambda p: F.trim(p))
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    none = F.array().cast("array<int>")

    def grow(orders: Column, _: Column) -> Column:
        return F.flatten(F.transform(orders, lambda o: F.transform(F.filter(places, lambda i: ~F.array_contains(o, i)), lambda i: F.concat(o, F.array(i)))))

    orders = F.aggregate(places, F.array(none), grow)
    texts = F.transform(orders, lambda o: F.array_join(F.transform(o, lambda i: F.get(parts, i)), " "))
    return F.array_sort(F.array_distinct(texts))


def permute_commas(terms: DataFrame, column: str, permutation: str = "permutation") -> DataFrame:
    """A row with each order of :func:`comma_permutations` for every row of ``terms``.

    One place is filled at a time, so a term of n parts gives n! rows without a list of them in any row.
    """
    parts = F.transform(F.split(F.col(column), ","), lambda p: F.trim(p))
    out = terms.withColumns({"__left": parts, "__done": F.array().cast("array<string>")})
    most = out.agg(F.max(F.size("__left")).alias("n")).first()["n"] or 0
    none = F.array(F.lit(None).cast("struct<i:int,p:string>"))
    for _ in range(most):
        places = F.transform("__left", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
        out = out.withColumn("__next", F.explode(F.when(F.size("__left") > 0, places).otherwise(none)))
        taken = F.col("__next").isNotNull()
        left = F.when(taken, F.filter("__left", lambda p, i: i != F.col("__next.i"))).otherwise(F.col("__left"))
        done = F.when(taken, F.concat("__done", F.array("__next.p"))).otherwise(F.col("__done"))
        out = out.withColumns({"__left": left, "__done": done}).drop("__next")
    return out.withColumn(permutation, F.array_join("__done", " ")).drop("__left", "__done").distinct()


def is_short(synonym: Column) -> Column:
    """One token of at most two characters, or of three letters."""
    one = ~F.contains(synonym, F.lit(" "))
    return one & ((F.length(synonym) <= 2) | ((F.length(synonym) <= 3) & synonym.rlike(r"^\p{L}+$")))


def screen_synonyms(synonyms: DataFrame, lexicon: DataFrame, strip: int = 2) -> DataFrame:
    """``synonym, reason``: everyday words (``english``, first) and short synonyms (``short``) that should be removed.

    An everyday word has no capitals after its first letter and is, itself or without its last ``strip`` characters,
    in ``lexicon`` (column ``word``). The lexicon is joined by hash on each form, so it may be of any size.
    """
    syn = F.col("synonym")
    tail = F.substring(syn, 2, 1 << 20)
    base = synonyms.select("synonym").distinct().withColumn("plain", tail == F.lower(tail))
    forms = base.filter("plain").select("synonym", F.explode(F.array(F.lower(syn), F.lower(F.left(syn, F.greatest(F.length(syn) - strip, F.lit(0)))))).alias("word"))
    english = forms.join(lexicon.select("word").distinct(), "word", "left_semi").select("synonym").distinct().withColumn("english", F.lit(True))
    reason = F.when(F.col("english"), "english").when(is_short(syn), "short")
    return base.join(english, "synonym", "left").select("synonym", reason.alias("reason")).filter("reason IS NOT NULL")


def publication_year(year: Column, other: Column) -> Column:
    """The year as a number, else four leading digits of the free date, else -1."""
    return F.coalesce(year.try_cast("int"), F.regexp_extract(F.coalesce(other, F.lit("")), r"^(\d{4})", 1).try_cast("int"), F.lit(-1))


def body_lines(text: Column) -> Column:
    """Lines of a full text after a line ``Body`` and before abbreviations or references, if it has such lines."""
    lines = F.split(text, "\n")
    low = F.transform(lines, lambda x: F.lower(F.trim(x)))
    begin = F.array_position(low, F.lit("body"))
    ends = F.array(*(F.array_position(low, F.lit(h)) for h in TAIL_HEADERS))
    first = F.array_min(F.filter(ends, lambda e: e > begin))
    return F.slice(lines, (begin + 1).cast("int"), (F.coalesce(first, F.size(lines) + 1) - begin - 1).cast("int"))


def sections(lines: Column) -> Column:
    """Struct of the text of each section: from its last exact header line to the next header; empty if absent."""
    low = F.transform(lines, lambda x: F.lower(F.trim(x)))
    total = F.size(lines)

    def place(header: str) -> Column:
        back = F.array_position(F.reverse(low), F.lit(header))
        return F.when(back > 0, total - back + 1)

    places = {h: place(h) for h in SECTION_HEADERS}
    every = F.array(*places.values())

    def part(header: str) -> Column:
        at = places[header]
        following = F.array_min(F.filter(every, lambda p: p > at))
        span = F.slice(lines, (at + 1).cast("int"), (F.coalesce(following, total + 1) - at - 1).cast("int"))
        return F.when(at.isNull(), F.lit("")).otherwise(F.array_join(span, " "))

    return F.struct(*(part(h).alias(h) for h in SECTION_HEADERS))


def shorten(label: Column, most: int, size: Column) -> Column:
    """A label cut to ``most`` characters with dots, followed by a size in brackets."""
    cut = F.when(F.length(label) > most, F.concat(F.substring(label, 1, most), F.lit("..."))).otherwise(label)
    return F.concat(cut, F.lit(" ("), size.cast("string"), F.lit(")"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Synonyms that are tried on every document in one projection at most; more are looked up by pieces.
LISTED_SYNONYMS = 200
#: Characters of a piece at most. Most texts hold most runs of three.
PIECE = 6
#: Synonyms whose pieces are sent to all tasks at most; those of a larger lexicon are exchanged.
SENT_SYNONYMS = 100_000
#: Characters of a word at most whose pieces are cut out one by one, each from its start.
LONG_WORD = 256
#: Fields that are searched in each mode.
FIELDS = {
    "abstract": ("title", "abstract"),
    "full_text": ("title", "abstract", "full_text"),
    "full_text_no_methods": ("title", "abstract", "introduction", "results", "discussion"),
}


def _pieces(text: Column, size: int) -> Column:
    """The different runs of ``size`` characters within the tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=([\p{{L}}\p{{N}}]{{{size}}}))"), 1))


def few(rows: DataFrame) -> bool:
    """Whether a lexicon is small enough for one projection; a count that stops early tells."""
    return rows.limit(LISTED_SYNONYMS + 1).count() <= LISTED_SYNONYMS


def very_many(rows: DataFrame) -> bool:
    """Whether a lexicon is too large to be sent to all tasks."""
    return rows.limit(SENT_SYNONYMS + 1).count() > SENT_SYNONYMS


def candidate_synonyms(docs: DataFrame, words: DataFrame, fields: list[str]) -> DataFrame:
    """``doc_id, synonym`` of every pair that may occur: the document holds the rarest piece of the synonym.

    Pieces are runs of :data:`PIECE` characters within tokens (fewer for synonyms of shorter tokens), so occurrences
    within words are found. Of the pieces of a synonym the one in the fewest documents is looked up, by exchanges
    of pieces and ids alone; a synonym with a piece that no document has cannot occur. Only pieces of the lexicon are
    exchanged, unless it is very large; then nothing is broadcast, so both sides may be of any size. Synonyms without a
    letter or digit are paired with all documents.
    """
    longest = F.array_max(F.transform(tokens(F.col("synonym")), lambda w: F.length(w)))
    sized = words.withColumn("size", F.least(F.coalesce(longest, F.lit(0)), F.lit(PIECE)))
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]
    wide = very_many(words)
    out = sized.filter("size = 0").select("synonym").crossJoin(docs.select("doc_id")).select("doc_id", "synonym") if 0 in sizes else None
    for size in sorted(set(sizes) - {0}):
        every = F.array_distinct(F.flatten(F.array(*(_pieces(F.col(f), size) for f in fields))))
        held = docs.select("doc_id", F.explode(every).alias("piece"))
        own = sized.filter(F.col("size") == size).select("synonym", F.explode(_pieces(F.col("synonym"), size)).alias("piece"))
        held = held if wide else held.join(F.broadcast(own.select("piece").distinct()), "piece")
        spread = held.groupBy("piece").agg(F.count("*").alias("n"))
        counted = own.join(spread.hint("merge"), "piece", "left").groupBy("synonym")
        rarest = counted.agg(F.min(F.struct("n", "piece")).alias("least"), F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all").select("synonym", "least.piece")
        found = held.join(rarest.hint("merge"), "piece").select("doc_id", "synonym")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select("doc_id", F.lit("").alias("synonym")).limit(0)


def count_in_words(docs: DataFrame, words: DataFrame, fields: list[str]) -> DataFrame:
    """``doc_id, synonym, cnt`` of synonyms of letters and digits alone, for every row of ``docs``.

    Such a synonym lies within one word, which is what stands between blanks or line ends. So the words of a row look up
    their runs of up to :data:`PIECE` characters among one piece a synonym, that which the fewest synonyms hold, and the
    counts in single words are added up by row. Texts are neither searched for each candidate nor exchanged; the pieces
    are sent to all tasks.
    """
    size = F.least(F.length("synonym"), F.lit(PIECE))
    own = words.select("synonym", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("synonym") - size + 1), lambda i: F.substring("synonym", i, size)))).alias("piece"))
    shared = own.groupBy("piece").agg(F.count("*").alias("n"))
    chosen = materialise(own.join(shared, "piece").groupBy("synonym").agg(F.min(F.struct("n", "piece")).alias("least")).select("least.piece", "synonym"), "pieces")
    sizes = [r["size"] for r in chosen.select(F.length("piece").alias("size")).distinct().collect()] or [PIECE]
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode(F.split(F.replace(F.concat_ws(" ", *fields), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    rows = rows.filter(F.length("word") >= min(sizes)).withColumn("size", F.explode(F.array(*map(F.lit, sizes))) if len(sizes) > 1 else F.lit(sizes[0]))
    patterns = F.create_map(*(v for k in sizes for v in (F.lit(k), F.lit(rf"(?=([\p{{L}}\p{{N}}]{{{k}}}))"))))
    long = F.length("word") > LONG_WORD
    rows = rows.filter(F.length("word") >= F.col("size")).withColumn("many", F.when(long, F.array_distinct(F.regexp_extract_all("word", F.element_at(patterns, F.col("size")), F.lit(1)))))
    places = F.sequence(F.lit(1), F.coalesce(F.size("many"), F.length("word") - F.col("size") + 1))
    rows = rows.filter("many IS NULL OR size(many) > 0").withColumn("at", F.explode(places))
    rows = rows.withColumn("piece", F.when(F.col("many").isNotNull(), F.get("many", F.col("at") - 1)).otherwise(F.substring("word", F.col("at"), F.col("size"))))
    met = rows.join(F.broadcast(chosen), "piece").filter(F.col("many").isNotNull() | (F.instr("word", F.col("piece")) == F.col("at")))
    times = met.select("row", "doc_id", "synonym", count_substring(F.col("word"), F.col("synonym")).alias("cnt")).filter("cnt > 0")
    return times.groupBy("row", "doc_id", "synonym").agg(F.sum("cnt").alias("cnt")).drop("row")


def count_synonyms(docs: DataFrame, synonyms: DataFrame, id_column: str = "doc_id", text_columns: tuple[str, ...] | str = "text") -> DataFrame:
    """``doc_id, synonym, cnt`` of every normalised synonym that occurs in the given fields of a document.

    Counting is on raw substrings of each field by itself; :data:`FIELDS` names those of the usual modes. A lexicon
    that a count shows to be small is tried on each document in one projection, where the documents are read. Of a
    larger one the synonyms of letters and digits alone are counted by :func:`count_in_words`; of the others, and of a
    very large one, only the pairs of :func:`candidate_synonyms` meet their texts. All ways count alike.
    """
    names = [text_columns] if isinstance(text_columns, str) else list(text_columns)
    fields = [f"f{i}" for i in range(len(names))]
    clean = docs.select(F.col(id_column).alias("doc_id"), *(normalise_hyphens(F.coalesce(F.col(c), F.lit(""))).alias(f) for c, f in zip(names, fields, strict=True)))
    words = synonyms.select(normalise_synonym(F.col("synonym")).alias("synonym")).filter("synonym <> ''").distinct()
    times = reduce(lambda a, b: a + b, (count_substring(F.col(f), F.col("synonym")) for f in fields))
    if few(words):
        listed = words.agg(F.collect_list("synonym").alias("synonyms"))
        hits = F.filter("synonyms", lambda s: any_of([F.contains(F.col(f), s) for f in fields]))
        both = clean.join(F.broadcast(listed)).select("doc_id", *fields, F.explode(hits).alias("synonym"))
        return both.select("doc_id", "synonym", times.alias("cnt")).filter("cnt > 0")
    token = F.lit(False) if very_many(words) else F.col("synonym").rlike(r"^[\p{L}\p{N}]+$")
    plain, rest = words.filter(token), words.filter(~token)
    out = count_in_words(docs.select(F.col(id_column).alias("doc_id"), *(F.col(c).alias(f) for c, f in zip(names, fields, strict=True))), plain, fields)
    if rest.isEmpty():
        return out
    both = candidate_synonyms(clean, rest, fields).join(clean.hint("merge"), "doc_id").select("doc_id", "synonym", times.alias("cnt")).filter("cnt > 0")
    return both if plain.isEmpty() else out.unionByName(both)
