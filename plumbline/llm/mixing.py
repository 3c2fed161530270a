"""Mixing sources to target weights, by budgets on a tree of domains, languages and sources.

Supplies and budgets are in tokens of the vocabulary that the texts will be encoded with, counted by
rank-synchronous merging, so that the weights hold in what is written. A node's budget goes to its children by weight. A child never gets more than it can supply (its
tokens times the number of epochs); what it can't take goes to its siblings by weight, and only when
all of them are full to the siblings of the node above. Each leaf then takes whole epochs and, of one
more, a prefix in an order seeded for that epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .tokencount import count_tokens

NONE = "(none)"
#: Leaves up to which the driver divides budgets and their plan is broadcast (some 100 bytes each); beyond, tasks
#: divide them and rows are joined to the plan by their leaf, with the same result.
BROADCAST = 200_000
#: Bits of an epoch's order that are looked at in turn; only rows of a leaf that share all of them are sorted.
BITS = (8, 16)
LEVELS = ("_domain", "_lang", "_source")


@dataclass(frozen=True)
class Mix:
    """What to aim at. `weights` maps paths (domain,), (domain, lang) or (domain, lang, source) to a weight among
    siblings; those that aren't listed share what the listed leave of 1, by their supply to the power `temper`. `domains` maps a source to
    its domain (others: `rest`). The budget is `share` of all tokens, spread over at most `epochs` epochs."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    rest: str = "other"
    temper: float = 0.5
    share: float = 0.9
    epochs: int = 3
    seed: int = 17


def spread(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Divide a whole budget among (weight, most) by weight, no child over its most, surplus to the others.

    Rounded down, then one more each by the largest remainder and place. Children of weight 0 get what the
    others can't take.
    """
    given = [0.0] * len(children)
    left = float(min(budget, sum(m for _, m in children)))
    for group in ([k for k, (w, _) in enumerate(children) if w > 0], [k for k, (w, _) in enumerate(children) if w <= 0]):
        open_ = [k for k in group if children[k][1] > 0]
        while open_ and left > 1e-6:
            total = sum(children[k][0] or 1.0 for k in open_)
            share = {k: left * (children[k][0] or 1.0) / total for k in open_}
            full = [k for k in open_ if share[k] >= children[k][1]]
            for k in full or open_:
                given[k] = min(share[k], float(children[k][1]))
                left -= given[k]
            if not full:
                left = 0.0
                break
            open_ = [k for k in open_ if k not in full]
    whole = [min(int(g + 1e-6), m) for g, (_, m) in zip(given, children)]
    missing = min(budget, sum(m for _, m in children)) - sum(whole)
    for k in sorted(range(len(children)), key=lambda k: (-(given[k] - whole[k]), k)):
        if missing > 0 and whole[k] < children[k][1]:
            whole[k] += 1
            missing -= 1
    for k, (_, most) in enumerate(children):  # rounding may leave a few tokens that only later children can take
        more = min(missing, most - whole[k])
        whole[k], missing = whole[k] + more, missing - more
    return whole


def shares(have: dict[tuple[str, ...], int], budget: int, mix: Mix) -> dict[tuple[str, ...], int]:
    """A node's budget among its children, by path and the tokens each has."""
    paths = sorted(have)
    listed = sum(mix.weights.get(path, 0.0) for path in paths)
    tempered = {path: have[path] ** mix.temper if have[path] else 0.0 for path in paths if path not in mix.weights}
    scale = max(0.0, 1.0 - listed) / (sum(tempered.values()) or 1.0)
    weights = [mix.weights[path] if path in mix.weights else tempered[path] * scale for path in paths]
    return dict(zip(paths, spread(budget, [(w, have[path] * mix.epochs) for w, path in zip(weights, paths)])))


def budgets(supply: dict[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Tokens to take from each leaf (domain, lang, source), for the tokens each has: from the root down."""
    parents: dict[tuple[str, ...], int] = {(): int(mix.share * sum(supply.values()))}
    for depth in range(1, len(LEVELS) + 1):
        have: dict[tuple[str, ...], dict] = {}
        for leaf, n in supply.items():
            own = have.setdefault(leaf[: depth - 1], {})
            own[leaf[:depth]] = own.get(leaf[:depth], 0) + n
        parents = {path: part for parent, own in have.items() for path, part in shares(own, parents[parent], mix).items()}
    return parents


def budget_table(stats: DataFrame, mix: Mix) -> DataFrame:
    """stats (LEVELS and _supply, settled) with _budget: by budgets(), or of very many leaves each node's children in a task."""
    if stats.count() <= BROADCAST:
        supply = {tuple(r[:3]): int(r["_supply"]) for r in stats.select(*LEVELS, "_supply").collect()}
        rows = [(*leaf, supply[leaf], budget) for leaf, budget in budgets(supply, mix).items()]
        return stats.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in LEVELS) + ", _supply long, _budget long")
    total = stats.agg(F.sum("_supply")).first()[0] or 0
    out = stats.select(*LEVELS, "_supply", F.lit(int(mix.share * total)).cast("long").alias("_budget"))

    def divider(own: list[str]):
        def divide(rows: pd.DataFrame) -> pd.DataFrame:
            paths = [tuple(r) for r in rows[own].itertuples(index=False)]
            given = shares(dict(zip(paths, rows["_supply"].tolist())), int(rows["_budget"].iloc[0]), mix)
            return rows[own].assign(_budget=[given[p] for p in paths])

        return divide

    for depth in range(1, len(LEVELS) + 1):
        own, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = out.groupBy(*own).agg(F.sum("_supply").alias("_supply"), F.first("_budget").alias("_budget"))
        divided = nodes.groupBy(*parent).applyInPandas(divider(own), ", ".join(f"{c} string" for c in own) + ", _budget long")
        out = settle(out.drop("_budget").join(divided, own), "budgets")
    return out


def order_key(epoch: Column | int, doc_id: str, seed: int) -> Column:
    """The place of a document in an epoch's order, as an unsigned 63-bit number."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), F.col(doc_id)), 1)


def leaf_columns(source: str, lang: str, mix: Mix) -> list[Column]:
    domain = F.lit(mix.rest)
    if mix.domains:
        table = F.create_map(*(F.lit(x) for pair in sorted(mix.domains.items()) for x in pair))
        domain = F.coalesce(table[F.coalesce(F.col(source), F.lit(NONE))], domain)
    return [domain.alias("_domain"), F.coalesce(F.col(lang), F.lit(NONE)).alias("_lang"), F.coalesce(F.col(source), F.lit(NONE)).alias("_source")]


def counted(df: DataFrame, doc_id: str, text: str, lang: str, source: str, mix: Mix, path: str, remembered: int) -> DataFrame:
    """LEVELS, _id and _n (tokens) of each row, settled: texts are counted once, only names and numbers are kept."""
    own = df.select(*leaf_columns(source, lang, mix), F.col(doc_id).alias("_id"), F.col(text).alias("_body"))
    return settle(count_tokens(own, "_body", path, [*LEVELS, "_id"], remembered=remembered).select(*LEVELS, "_id", F.col("n_tokens").alias("_n")), "tokens")


def plan(narrow: DataFrame, mix: Mix) -> DataFrame:
    """A row for each leaf of narrow (LEVELS, _id, _n): its columns, _supply, _budget, _epochs (taken whole), and _key,
    _last: the place of the last document of the prefix taken in one more epoch (nulls: none).

    A leaf's prefix is found without sorting the leaf: sums over slots of the epoch's order tell the slot
    in which the budget ends, sums over its own slots the one within, and that one's rows alone are
    sorted. A prefix ends before the document that would exceed the budget.
    """
    stats = settle(narrow.groupBy(*LEVELS).agg(F.sum("_n").alias("_supply")), "supply")
    leaves = budget_table(stats, mix).withColumn("_epochs", F.expr("coalesce(cast(_budget div nullif(_supply, 0) as int), 0)"))
    leaves = settle(leaves.withColumn("_left", F.col("_budget") - F.col("_epochs") * F.col("_supply")), "leaves")
    near = met(leaves)
    part = narrow.join(near(leaves.where("_left > 0")), list(LEVELS))
    part = part.select(*LEVELS, "_id", "_n", "_left", order_key(F.col("_epochs"), "_id", mix.seed).alias("_key"))
    inside = part.withColumn("_before", F.lit(0).cast("long"))
    for bits in BITS:
        slot = F.shiftright("_key", 63 - bits)
        slots = inside.groupBy(*LEVELS, slot.alias("_slot")).agg(F.sum("_n").alias("_sum"), F.first("_left").alias("_left"), F.first("_before").alias("_before"))
        # a row for each leaf and slot, 256 for a leaf at most
        upto = F.sum("_sum").over(Window.partitionBy(*LEVELS).orderBy("_slot")) + F.col("_before")
        ended = slots.withColumn("_upto", upto).where("_upto > _left").groupBy(*LEVELS)
        # the first slot that doesn't fit; a prefix is never all of a leaf, so there is one
        cut = settle(ended.agg(F.min("_slot").alias("_cut"), F.min_by(F.col("_upto") - F.col("_sum"), "_slot").alias("_before")), "cut")
        inside = part.join(near(cut), list(LEVELS)).where(slot == F.col("_cut"))
    within = Window.partitionBy(*LEVELS).orderBy("_key", "_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_run", F.sum("_n").over(within) + F.col("_before"))
    ends = inside.where("_run <= _left").groupBy(*LEVELS).agg(F.max(F.struct("_key", "_id")).alias("_at"))
    found = leaves.join(cut, list(LEVELS), "left").join(ends, list(LEVELS), "left")
    # without a document of the divided slot in the prefix, it ends with the slot before
    edge = F.shiftleft(F.col("_cut"), 63 - BITS[-1]) - 1
    return settle(
        found.select(*LEVELS, "_supply", "_budget", "_epochs", F.coalesce("_at._key", edge).alias("_key"), F.col("_at._id").alias("_last")), "mix"
    )


def met(leaves: DataFrame):
    """How rows meet a table with a row for each leaf: broadcast if there are few leaves."""
    return F.broadcast if leaves.count() <= BROADCAST else lambda df: df


def taken(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """rows (LEVELS, _id and others) once for each time a document is taken, with the epoch (from 0) as _epoch."""
    ends = leaves.select(*LEVELS, "_epochs", F.col("_key").alias("_end"), "_last")
    own = rows.join(met(ends)(ends), list(LEVELS))
    key = order_key(F.col("_epochs"), "_id", mix.seed)
    tie = (key == F.col("_end")) & (F.col("_last").isNull() | F.col("_id").isNull() | (F.col("_id") <= F.col("_last")))
    in_prefix = F.coalesce((key < F.col("_end")) | tie, F.lit(False))
    times = F.col("_epochs") + in_prefix.cast("int")
    epochs = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return own.select(*rows.columns, F.explode(epochs).alias("_epoch"))


def mix_sources(df: DataFrame, doc_id: str, text: str, lang: str, source: str, mix: Mix, path: str, remembered: int = 700_000) -> DataFrame:
    """df's columns, then mix_domain, mix_lang, mix_source and mix_epoch (from 0): a row for each time a document is taken.

    Supplies are counted in tokens of the vocabulary file at `path`. A leaf's documents are all taken in
    its whole epochs, and in one more those of a prefix of its seeded order; rows that share an id go
    together. Null languages and sources are leaves of their own. A leaf without tokens (null or empty
    texts) isn't taken, and an empty table gives an empty result. Where df has a column of one of the
    names added, the added one gets an underscore. Texts aren't shuffled, unless there are more than
    BROADCAST leaves.
    """
    leaves = plan(counted(df, doc_id, text, lang, source, mix, path, remembered), mix)
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("_whole"), *leaf_columns(source, lang, mix), F.col(doc_id).alias("_id"))
    added = []
    for name in ("mix_domain", "mix_lang", "mix_source", "mix_epoch"):
        while name in df.columns:
            name += "_"
        added.append(name)
    return taken(rows, leaves, mix).select("_whole.*", *(F.col(c).alias(n) for c, n in zip((*LEVELS, "_epoch"), added)))


def mix_table(df: DataFrame, doc_id: str, text: str, lang: str, source: str, mix: Mix, path: str, remembered: int = 700_000) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of what mix_sources takes, without reading texts again.

    Null languages and sources come back as null. Repeated rows repeat; an empty table gives an empty result.
    """
    narrow = counted(df, doc_id, text, lang, source, mix, path, remembered)
    out = taken(narrow, plan(narrow, mix), mix)
    known = lambda c: F.when(F.col(c) != NONE, F.col(c))
    return out.select(F.col("_id").alias("doc_id"), F.col("_domain").alias("domain"), known("_lang").alias("lang"), known("_source").alias("source"), F.col("_epoch").alias("epoch"), F.col("_n").alias("n_tokens"))


def production_mix() -> Mix:
    """Domains of the known sources, and the weights to aim at; other sources form the domain `other`."""
    names = {"crawl": range(0, 1), "reference": range(1, 7), "forum": range(7, 14), "news": range(14, 20)}
    weights = {("crawl",): 0.4, ("reference",): 0.25, ("forum",): 0.15, ("news",): 0.18}
    weights |= {(d, lang): w for d in names for lang, w in (("en", 0.5), ("fr", 0.2), ("de", 0.2))}
    return Mix(weights=weights, domains={f"src{k}": d for d, own in names.items() for k in own})
