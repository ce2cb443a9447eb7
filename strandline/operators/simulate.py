"""Mutated copies of sequences with the alignment that made them.

All choices come from hashes of (seed, id, place): the same call gives the same
copies on any cluster and in any order of tasks.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a stretch that changes are looked for in.
STRETCH = 1 << 12
#: Mean of the published copy-number events. Fixed value.
MEAN_RUN = 1.6594594594594594


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _changed(stretches: DataFrame, seed: int, mismatch: float, deletion: float, insertion: float) -> DataFrame:
    """id, key, size, offset, ``text`` and ``events`` (pos, len, op) of stretches (id, key, size, name, first, offset, part).

    Choices hang on ``name`` and the letter's place, ``first`` + i. Only letters that change are ever more than a number.
    """
    u = lambda i, salt=0: _uniform(F.lit(seed + salt), F.col("name"), F.col("first") + i)
    pick = lambda letters, i, salt: F.substring(letters, (F.floor(u(i, salt) * F.length(letters)) + 1).cast("int"), F.lit(1))
    base = lambda i: F.substring("part", i + 1, F.lit(1))
    op = lambda i: F.when(u(i) < mismatch, "X").when(u(i) < mismatch + deletion, "D").otherwise("I")

    def new(c: Column) -> Column:
        others = F.replace(F.lit("ACGT"), F.upper(base(c["i"])), F.lit(""))
        return F.when(c["op"] == "X", pick(others, c["i"], 1)).when(c["op"] == "D", "").otherwise(F.concat(pick(F.lit("ACGT"), c["i"], 2), base(c["i"])))

    places = F.filter(F.sequence(F.lit(0), F.length("part") - 1), lambda i: u(i) < mismatch + deletion + insertion)
    rows = stretches.select("*", F.transform(places, lambda i: F.struct(i.alias("i"), op(i).alias("op"))).alias("changes"))
    reached = lambda j: F.coalesce(F.get("changes", j - 1)["i"] + 1, F.lit(0))
    parts = F.transform("changes", lambda c, j: F.concat(F.substring("part", reached(j) + 1, c["i"] - reached(j)), new(c)))
    text = F.concat(F.array_join(parts, ""), F.substring("part", reached(F.size("changes")) + 1, F.length("part")))
    events = F.transform("changes", lambda c: F.struct((F.col("offset") + F.col("first") + c["i"]).cast("long").alias("pos"), F.lit(1).cast("long").alias("len"), c["op"].alias("op")))
    return rows.select("id", "key", "size", "offset", text.alias("text"), events.alias("events"))


def _stretches(rows: DataFrame) -> DataFrame:
    """Rows (id, size, name, side, offset, seq) as stretches that ``_changed`` takes; ``key`` puts them in order."""
    cut = rows.filter(F.length("seq") > 0).withColumn("first", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(STRETCH))))
    return cut.select("id", F.struct("side", "first").alias("key"), "size", "name", "first", "offset", F.substring("seq", F.col("first") + 1, F.lit(STRETCH)).alias("part"))


def _joined(changed: DataFrame, more: Column | None = None) -> DataFrame:
    """seq_id, mutated and cigar of what ``_changed`` gives; ``more`` is an event of each id, an aggregate."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda s: s["text"])
    events = F.flatten(F.collect_list("events"))
    events = events if more is None else F.concat(events, F.filter(F.array(more), lambda e: e["len"] > 0))
    whole = changed.groupBy("id").agg(F.array_join(texts, "").alias("mutated"), F.array_sort(events).alias("ev"), F.max("size").cast("long").alias("size"))
    # Where runs begin: mismatches and deletions go on right behind one of their kind, insertions never.
    follows = lambda i: (F.get("ev", i)["op"] != "I") & (F.get("ev", i)["op"] == F.get("ev", i - 1)["op"]) & (F.get("ev", i)["pos"] == F.get("ev", i - 1)["pos"] + F.get("ev", i - 1)["len"])
    numbers = F.when(F.size("ev") > 0, F.sequence(F.lit(0), F.size("ev") - 1)).otherwise(F.array().cast("array<int>"))
    whole = whole.withColumn("runs", F.filter(numbers, lambda i: (i == 0) | ~follows(i)))
    # A deletion's or mismatch's letters are used up, what an insertion stands before isn't.
    end = lambda i: F.get("ev", i)["pos"] + F.when(F.get("ev", i)["op"] == "I", 0).otherwise(F.get("ev", i)["len"])
    reached = lambda i: F.coalesce(end(i - 1), F.lit(0).cast("long"))
    matched = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("M"))).otherwise("")

    def run(i: Column, j: Column) -> Column:
        e, last = F.get("ev", i), F.coalesce(F.get("runs", j + 1), F.size("ev")) - 1
        n = F.when(e["op"] == "I", e["len"]).otherwise(end(last) - e["pos"])
        return F.concat(matched(e["pos"] - reached(i)), n.cast("string"), e["op"])

    cigars = F.concat(F.array_join(F.transform("runs", run), ""), matched(F.col("size") - reached(F.size("ev"))))
    return whole.select(F.col("id").alias("seq_id"), "mutated", cigars.alias("cigar"))


def mutate(seqs: DataFrame, seed: int = 0, mismatch: float = 0.001, deletion: float = 0.0001, insertion: float = 0.0001) -> DataFrame:
    """seq_id, mutated and cigar: point changes letter by letter. An insertion puts a base before the letter."""
    rows = seqs.select(F.col("seq_id").alias("id"), F.length("seq").alias("size"), F.col("seq_id").alias("name"), F.lit(0).alias("side"), F.lit(0).alias("offset"), "seq")
    return _joined(_changed(_stretches(rows), seed, mismatch, deletion, insertion))


def delete_once(seqs: DataFrame, seed: int = 0, rate: float = 0.02, length: int = 1000) -> DataFrame:
    """One deletion of ``length`` letters at a random place, and point changes at ``rate`` in all around it.

    Sequences of ``length`` letters or fewer have no place for it and are left out.
    """
    fits = seqs.filter(F.length("seq") > length)
    start = F.floor(_uniform(F.lit(seed), "seq_id") * (F.length("seq") - length)).cast("int")
    name = lambda side: F.concat_ws("/", F.col("seq_id").cast("string"), F.lit(side))
    half = lambda side, tag, offset, text: F.struct(F.lit(side).alias("side"), name(tag).alias("name"), offset.alias("offset"), text.alias("seq"))
    both = F.array(half(0, "a", F.lit(0), F.substring("seq", F.lit(1), F.col("start"))), half(1, "b", F.col("start") + length, F.substring(F.col("seq"), F.col("start") + length + 1, F.length("seq"))))
    cut = fits.withColumn("start", start).select(F.col("seq_id").alias("id"), F.length("seq").alias("size"), F.inline(both))
    changed = _changed(_stretches(cut), seed + 7, rate / 2, rate / 4, rate / 4)
    # The second half is never empty, and the deletion lies right before it.
    gap = F.struct((F.max("offset") - length).cast("long").alias("pos"), F.lit(length).cast("long").alias("len"), F.lit("D").alias("op"))
    return _joined(changed, gap)


def copy_number(seqs: DataFrame, events: int, seed: int = 0, mean_run: float = MEAN_RUN, duplicate: float = 0.5) -> DataFrame:
    """seq_id, mutated and cigar: runs of units duplicated or deleted.

    ``seqs`` has seq_id, seq and ``starts``, the sorted starts of its units (the
    first is taken as 0). Run lengths are 1 + Poisson(mean_run - 1); the last unit
    is never part of a run, and an event whose run has no place changes nothing.
    The events make a list of units, held as ranges of numbers: each event adds two at
    most, however many units there are. What the alignment does at a range follows from the
    largest unit before it.
    """
    size = F.length("seq")
    later = F.slice(F.coalesce("starts", F.array().cast("array<long>")), F.lit(2), F.greatest(F.coalesce(F.size("starts"), F.lit(0)), F.lit(0)))
    named = seqs.select(F.col("seq_id").cast("string").alias("seq_id"), F.coalesce("seq", F.lit("")).alias("seq"), F.col("starts").cast("array<long>").alias("starts"))
    cuts = named.withColumn("cuts", F.concat(F.array(F.lit(0).cast("long")), later, F.array(size.cast("long"))))

    draw = lambda event, salt: _uniform(F.lit(seed), F.col("seq_id"), event, F.lit(salt))
    shares = F.array(*map(F.lit, _poisson_shares(mean_run - 1)))
    run_of = lambda event: F.size(F.filter(shares, lambda c: c <= draw(event, 1))) + 1
    plan = F.transform(F.sequence(F.lit(1), F.lit(events)), lambda e: F.struct(run_of(e).alias("run"), draw(e, 2).alias("where"), (draw(e, 3) < duplicate).alias("twice"))) if events else F.array().cast("array<struct<run:int,where:double,twice:boolean>>")

    def change(now: Column, event: Column) -> Column:
        """Ranges of units (from, to, and the place of the first in the list) after an event."""
        room = F.element_at(now, -1)["at"] + F.element_at(now, -1)["to"] - F.element_at(now, -1)["from"] - event["run"]
        at = F.floor(event["where"] * room).cast("int")
        head, tail = at + F.when(event["twice"], event["run"]).otherwise(0), at + F.when(event["twice"], 0).otherwise(event["run"])
        front = F.transform(F.filter(now, lambda r: r["at"] < head), lambda r: _range(r["from"], F.least(r["to"], r["from"] + head - r["at"]), r["at"]))
        passed = lambda r: F.greatest(tail - r["at"], F.lit(0))
        back = F.transform(F.filter(now, lambda r: r["at"] + r["to"] - r["from"] > tail), lambda r: _range(r["from"] + passed(r), r["to"], r["at"] + passed(r) - tail + head))
        return F.when(room < 1, now).otherwise(F.concat(front, back))

    whole = F.array(_range(F.lit(0), F.size("cuts") - 1, F.lit(0)))
    listed = cuts.select("*", F.aggregate(plan, whole, change).alias("ranges"))
    begin = lambda unit: F.get("cuts", unit)
    text = F.array_join(F.transform("ranges", lambda r: F.substring(F.col("seq"), (begin(r["from"]) + 1).cast("int"), (begin(r["to"]) - begin(r["from"])).cast("int"))), "")
    step = lambda n, op: F.struct(n.cast("long").alias("len"), F.lit(op).alias("op"))

    def follow(done: Column, r: Column) -> Column:
        """``top`` units are reached: what lies below is inserted again, what is passed over was deleted."""
        top = done["top"]
        new = F.greatest(r["from"], top)
        some = F.array(step(begin(F.least(r["to"], top)) - begin(r["from"]), "I"), step(begin(new) - begin(top), "D"), step(begin(r["to"]) - begin(new), "M"))
        some = F.filter(some, lambda s: (s["len"] > 0) & ((r["to"] > top) | (s["op"] == "I")))
        return F.struct(F.greatest(top, r["to"]).alias("top"), F.concat(done["steps"], some).alias("steps"))

    none = F.struct(F.lit(0).alias("top"), F.array().cast("array<struct<len:bigint,op:string>>").alias("steps"))
    last = lambda done: F.concat(done["steps"], F.filter(F.array(step(size - begin(done["top"]), "D")), lambda s: s["len"] > 0))
    steps = listed.select("seq_id", text.alias("mutated"), F.aggregate("ranges", none, follow, last).alias("steps"))
    # Neighbours of one op are one step.
    numbers = F.when(F.size("steps") > 0, F.sequence(F.lit(0), F.size("steps") - 1)).otherwise(F.array().cast("array<int>"))
    steps = steps.withColumn("runs", F.filter(numbers, lambda i: (i == 0) | (F.get("steps", i)["op"] != F.get("steps", i - 1)["op"])))

    def run(i: Column, j: Column) -> Column:
        many = F.coalesce(F.get("runs", j + 1), F.size("steps")) - i
        total = F.aggregate(F.slice("steps", i + 1, many), F.lit(0).cast("long"), lambda n, s: n + s["len"])
        return F.concat(total.cast("string"), F.get("steps", i)["op"])

    return steps.select("seq_id", "mutated", F.array_join(F.transform("runs", run), "").alias("cigar"))


def _range(begin: Column, end: Column, at: Column) -> Column:
    return F.struct(begin.alias("from"), end.alias("to"), at.alias("at"))


def _poisson_shares(mean: float) -> list[float]:
    """The share of draws of 0, of 0 and 1, and so on, until all but none are in."""
    share = term = exp(-mean)
    out = [share]
    while 1 - share > 1e-15 and len(out) < 1000:
        term *= mean / len(out)
        share += term
        out.append(share)
    return out
