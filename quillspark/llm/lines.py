"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line goes if a line before it (by document, then place) equals it, or is within the
edits allowed. Edits count whole symbols: the words of a line that has at least
``WORDS`` of them, otherwise its characters, as also in scripts that use no spaces. How
many are allowed grows with the shorter line (``STEPS``): in words one from 8 on, two from
24, three from 48; in characters from 20, 40 and 80.

Equal lines are found by hash alone. The first of each is joined as follows:

* A line with ``t`` edits allowed is indexed by its ``t + 1`` segments, under its length
  and the segment's number. Any line within ``t`` edits and no shorter holds one of the
  segments whole, and how far it can have moved follows from the segment's number and
  both lengths. So each line probes the index with those substrings of its own, for each
  length from its own down to as many symbols fewer as edits are allowed.
* Each probe first meets the first line of an index entry alone (its head), which decides
  most of a group of near copies by one comparison for each line.
* What is still undecided meets the other lines of its entries, as far as their symbols'
  parities allow: an edit changes at most two bits of 128. So of a hot entry only pairs
  leave the join that are near or almost.

Texts are read again for candidates only, and verified by a banded bit-parallel edit
distance: for each number of edits, one bit for each diagonal of the band says whether
it is reached, and all diagonals advance by one symbol at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, meeting, written
from .words import text_column

#: Lines of at least so many words are compared by words, others by characters.
WORDS = 8
#: From how many symbols on one, two and three edits are allowed: words, characters.
STEPS = ((8, 24, 48), (20, 40, 80))
MOST = len(STEPS[0])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no, line) of the lines that aren't blank."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _symbols(lines: DataFrame) -> DataFrame:
    """With ``symbols``, ``by_word`` and their number ``n``."""
    words = F.split("line", " ", -1)
    lines = lines.withColumn("words", words)
    # Three bytes a character on average: a script that uses no or few spaces.
    by_word = (F.size("words") >= WORDS) & (F.octet_length("line") <= 2 * F.length("line"))
    lines = lines.withColumn("by_word", by_word)
    symbols = F.when(F.col("by_word"), F.col("words")).otherwise(F.array_remove(F.split("line", ""), ""))
    return lines.withColumn("symbols", symbols).drop("words").withColumn("n", F.size("symbols"))


def allowed(n: Column, by_word: Column) -> Column:
    """The edits allowed for a line of ``n`` symbols."""
    steps = [F.when(by_word, w).otherwise(c) for w, c in zip(*STEPS, strict=True)]
    return reduce(lambda a, b: a + b, ((n >= s).cast("int") for s in steps))


def probes(t: int, more: int) -> list[tuple[int, int]]:
    """(segment, shift): where a line of ``more`` more symbols can hold a segment of one with ``t`` edits allowed.

    Seen from the left, segment ``k`` (from 0) has at most ``k`` edits before it if it is the
    first whole one; seen from the right, at most ``t - k`` behind it. So it always lies inside the line.
    """
    return [(k, shift) for k in range(t + 1) for shift in range(max(-k, more - (t - k)), min(k, more + (t - k)) + 1)]


def _keyed(lines: DataFrame) -> DataFrame:
    """``lines`` with the keys that each is indexed by (``own``), and those that it probes."""
    n, by_word, hashes = F.col("n"), F.col("by_word"), F.col("hashes")
    # A symbol is in many segments, so each is hashed once.
    lines = lines.withColumn("hashes", F.transform("symbols", lambda x: F.xxhash64(x)))
    mores, segments = range(MOST + 1), range(MOST + 1)
    # Of a line of ``more`` symbols fewer: the edits allowed, and where its segments start and how long they are, the later ones being longer.
    lines = lines.withColumns({f"t{more}": allowed(n - more, by_word) for more in mores} | {f"of{more}": F.xxhash64(by_word, n - more) for more in mores})
    for more in mores:
        parts = F.col(f"t{more}") + 1
        size = F.floor((n - more) / parts).cast("int")
        lines = lines.withColumns({f"size{more}": size, f"short{more}": parts - (n - more) + size * parts})
    lines = lines.withColumns({f"start{more}_{k}": k * F.col(f"size{more}") + F.greatest(F.lit(0), k - F.col(f"short{more}")) for more in mores for k in segments})

    def key(more: int, k: int, shift: int, least: int) -> Column:
        """Null if fewer edits than ``least`` are allowed. Written out for each place, as Spark compiles such expressions, but no lambda."""
        length = F.col(f"size{more}") + (F.col(f"short{more}") <= k).cast("int")
        return F.when(F.col(f"t{more}") >= least, F.xxhash64(F.col(f"of{more}").bitwiseXOR(F.lit(k)), F.slice("hashes", F.col(f"start{more}_{k}") + shift + 1, length)))

    # What is probed with some edits allowed is probed with more of them, too.
    places = {(more, k, shift): min(t for t in range(max(1, more), MOST + 1) if (k, shift) in probes(t, more)) for more in mores for k, shift in probes(MOST, more)}
    # With a lambda, which ``array_compact`` has, beside it, the long array isn't put into the one method of a whole stage, which the JVM would leave interpreted.
    own = F.array_compact(F.array(*(key(0, k, 0, max(1, k)) for k in segments)))
    probing = F.array_except(F.array(*(key(*place, least) for place, least in places.items())), F.array(F.lit(None).cast("long")))
    return lines.select("doc_id", "no", "h1", "h2", own.alias("own"), probing.alias("probes"))


def edit_distance(a: Column, b: Column) -> Column:
    """The edits between two arrays of symbols, or null if more than ``MOST``.

    ``r[e]`` has bit ``d + MOST`` set if ``i`` symbols of ``a`` become ``i + d`` symbols of ``b`` by ``e`` edits. With
    the next symbol of ``a``, a diagonal goes on where symbols match; an edit leads on along the diagonal
    (replace), from the one above (delete) or, without a symbol of ``a``, to the next (insert). What both begin
    and end with alike is left out first, which changes no distance.
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    # From 1; 0 if they are equal.
    differ = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")

    def between(at: Column) -> Column:
        ends = F.least(at["back"], F.size(a) - at["front"] + 2, F.size(b) - at["front"] + 2) - 1
        middle = lambda x: F.slice(x, at["front"], F.size(x) - at["front"] + 1 - ends)
        return F.when(at["front"] == 0, 0).otherwise(let(F.struct(middle(a).alias("a"), middle(b).alias("b")), lambda m: _banded(m["a"], m["b"])))

    return let(F.struct(differ(a, b).alias("front"), differ(F.reverse(a), F.reverse(b)).alias("back")), between)


def _banded(a: Column, b: Column) -> Column:
    width = (1 << (2 * MOST + 1)) - 1
    match = lambda x, i: reduce(lambda m, d: m.bitwiseOR(F.when(x.eqNullSafe(F.when(i + d >= 0, F.get(b, i + d))), 1 << (d + MOST)).otherwise(0)), range(-MOST, MOST + 1), F.lit(0))

    def step(state: Column, mask: Column) -> Column:
        new: list[Column] = []
        for e in range(MOST + 1):
            reached = state[f"r{e}"].bitwiseAND(mask)
            if e:
                before = state[f"r{e - 1}"]
                reached = reached.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(width))
            new.append(reached)
        return F.struct(*(x.alias(f"r{e}") for e, x in enumerate(new)))

    start = F.struct(*(F.lit(sum(1 << (d + MOST) for d in range(e + 1))).alias(f"r{e}") for e in range(MOST + 1)))
    last = F.size(b) - F.size(a) + MOST
    ends = lambda state: F.coalesce(*(F.when(F.call_function("shiftright", state[f"r{e}"], last).bitwiseAND(F.lit(1)) == 1, e) for e in range(MOST + 1)))
    return F.when((last >= 0) & (last <= 2 * MOST), F.aggregate(F.transform(a, match), start, step, ends))


def _parity(symbols: Column, half: int) -> Column:
    """64 of 128 bits, each the parity of the symbols hashed to it."""
    bits = F.filter(F.transform(symbols, lambda x: F.pmod(F.xxhash64(x), F.lit(128)).cast("int") - 64 * half), lambda b: (b >= 0) & (b < 64))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda p, b: p.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def _apart() -> Column:
    """In how many parities two lines differ: by each edit in two at most."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"parity{k}").bitwiseXOR(F.col(f"other_parity{k}"))) for k in (0, 1)))


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (doc_id, no, other_doc, other_no), the later line of each pair that is within the edits allowed."""
    others = texts.select(F.col("doc_id").alias("other_doc"), F.col("no").alias("other_no"), F.col("symbols").alias("other"), F.col("parity0").alias("other_parity0"), F.col("parity1").alias("other_parity1"))
    both = pairs.join(texts.select("doc_id", "no", "symbols", "by_word", "parity0", "parity1"), ["doc_id", "no"]).join(others, ["other_doc", "other_no"])
    most = allowed(F.least(F.size("symbols"), F.size("other")), F.col("by_word"))
    close = both.where((_apart() <= 2 * most) & (edit_distance(F.col("symbols"), F.col("other")) <= most))
    later = F.greatest(F.struct("doc_id", "no"), F.struct(F.col("other_doc").alias("doc_id"), F.col("other_no").alias("no")))
    return written(close.select(later.alias("l")).select("l.*").distinct(), "near-lines")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, no): the lines to drop. ``docs`` has doc_id and text, neither null."""
    place = F.struct("doc_id", "no")
    lines = _lines(docs).withColumns({"h1": F.xxhash64("line"), "h2": F.hash("line")})
    # A document's place among all as one number, so that the first of equal lines is found by a hash aggregation.
    number = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("no")
    firsts = lines.select("h1", "h2", number.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count("*").alias("times")).where("times > 1")
    firsts = written(firsts.drop("times"), "repeated-lines")
    # Both grow with the lines, so they are joined alike at every size.
    keyed = _keyed(_symbols(lines)).join(firsts.hint("shuffle_hash"), ["h1", "h2"], "left")
    table = written(keyed.select("doc_id", "no", "own", "probes", (F.col("place") != number).alias("again")), "line-keys")
    forget(firsts)
    equal = written(table.where("again").select("doc_id", "no"), "equal-lines")
    keyed = table.where("again is null or not again")
    index = keyed.select(F.explode("own").alias("key"), "doc_id", "no")
    heads = written(index.groupBy("key").agg(F.min(number).alias("head"), F.count("*").alias("lines")), "line-heads")
    other_no = F.pmod("head", F.lit(1 << 31).cast("decimal(11,0)"))
    other_doc = ((F.col("head") - other_no) / F.lit(1 << 31).cast("decimal(11,0)")).cast("long")
    # First against the first line of each entry.
    met = keyed.select(F.explode("probes").alias("key"), "doc_id", "no").join(heads.hint("shuffle_hash"), "key").where(F.col("head") != number)
    met = written(met.select("key", "lines", "doc_id", "no", other_doc.alias("other_doc"), other_no.cast("int").alias("other_no")), "line-probes")
    to_heads = met.select("doc_id", "no", "other_doc", "other_no").distinct()
    # Texts of all that meet: the lines that probe, and those of the entries probed.
    entries = met.where("lines > 1").select("key").distinct()
    rest = written(index.join(entries.hint("merge"), "key").select("key", F.col("doc_id").alias("other_doc"), F.col("no").alias("other_no")), "line-entries")
    wanted = met.select("doc_id", "no").union(met.select("other_doc", "other_no")).union(rest.select("other_doc", "other_no")).distinct()
    wanted = written(wanted, "line-ids")
    forget(table, heads)
    texts = _symbols(_lines(meeting(docs, wanted, "doc_id", "left_semi")).join(wanted, ["doc_id", "no"])).drop("line")
    texts = written(texts.dropDuplicates(["doc_id", "no"]).withColumns({f"parity{k}": _parity(F.col("symbols"), k) for k in (0, 1)}), "line-texts")
    forget(wanted)
    near = _near(to_heads, texts)
    # What is still undecided meets the rest of its entries.
    sketch = texts.join(near.withColumn("gone", F.lit(True)), ["doc_id", "no"], "left").select("doc_id", "no", "n", "by_word", "parity0", "parity1", F.col("gone").isNull().alias("open"))
    left = met.where("lines > 1").select("key", "doc_id", "no").join(sketch, ["doc_id", "no"])
    right = rest.join(sketch.select(*(F.col(c).alias(f"other_{c}") for c in sketch.columns)).withColumnRenamed("other_doc_id", "other_doc"), ["other_doc", "other_no"])
    behind = F.struct("other_doc", "other_no") < place
    fit = F.when(behind, F.col("open")).otherwise(F.col("other_open")) & ((F.col("doc_id") != F.col("other_doc")) | (F.col("no") != F.col("other_no")))
    fit = fit & (_apart() <= 2 * allowed(F.least("n", "other_n"), F.col("by_word")))
    to_rest = left.join(right, "key").where(fit).select("doc_id", "no", "other_doc", "other_no").distinct()
    more = _near(to_rest, texts)
    gone = written(equal.union(near).union(more).groupBy("doc_id").agg(F.collect_set("no").alias("gone")), "dropped-lines")
    forget(equal, met, rest, texts, near, more)
    return gone


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_text (the lines that stay), and the columns named in ``carry``.

    Of equal and near lines the first by (document, place) stays; whether a line goes depends on
    lines of the input alone, dropped or not, so that ties of place can't occur. Lines compared by
    words and lines compared by characters aren't near to each other. Blank lines stay. Null texts stay null and have
    no lines; an empty text has one blank line. Rows without an id stay whole and remove nothing
    elsewhere. Rows that share an id lose lines at the same places. Lines and texts of any length are
    compared whole. Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    held = [f"carried_{k}" for k in range(len(carry))]
    read = text_column(docs, id_col, text_col, *(F.col(c).alias(h) for c, h in zip(carry, held, strict=True)))
    dropped = repeated_lines(read.select("doc_id", "text").where("doc_id is not null and text is not null"))
    # Joined alike at every size, as ``dropped`` grows with the documents.
    cut = meeting(read, dropped.select("doc_id"), "doc_id", "left_semi").join(dropped.hint("merge"), "doc_id").select("doc_id", "text", "gone", *held)
    whole = meeting(read, dropped, "doc_id", how="left_anti").select("doc_id", "text", F.array().cast("array<int>").alias("gone"), *held)
    every = F.split("text", "\n", -1)
    kept = F.when(F.size("gone") == 0, every).otherwise(F.filter(every, lambda line, no: ~F.array_contains("gone", no)))
    out = cut.unionByName(whole).select("doc_id", F.coalesce(F.when(F.col("text").isNotNull(), F.size(every)), F.lit(0)).cast("long").alias("n_lines"), kept.alias("kept"), *held)
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.when(F.col("kept").isNotNull(), F.col("n_lines") - F.size("kept")), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join("kept", "\n").alias("kept_text"),
        *(F.col(h).alias(c) for c, h in zip(carry, held, strict=True)),
    )
