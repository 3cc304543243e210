"""Economic attribution: whether a quote states that an entity took part in an event, by relation frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.extraction import NEGATED

# What may stand between a name and its verb, and the relation frames
# (attribution, role, relation, event types or none, text before the name, text after it).
# {peer} is the related entity.
LEAD = r"(?:[®™])?(?:,\s+[^,;.!?]{1,160},)?\s+(?:today\s+)?(?:announced\s+(?:that\s+)?it\s+(?:has\s+)?|has\s+)?"
BUY = r"(?:acquired|acquires|agreed to acquire|will acquire)\s+"
FRAMES = (
    ("direct_participant", "buyer", "transaction", ("ma",), "", LEAD + BUY + "{peer}"),
    ("direct_participant", "target", "transaction", ("ma",), "{peer}" + LEAD + BUY, ""),
    ("direct_participant", "contract_party", "supply_contract", (), "", LEAD + r"signed (?:a |an )?(?:supply|purchase) (?:agreement|contract) with\s+{peer}"),
    ("direct_participant", "supplier", "supply_contract", (), "", LEAD + r"will supply\s+{peer}\s+under a (?:supply )?(?:agreement|contract)\b"),
    ("direct_participant", "customer", "supply_contract", (), "", LEAD + r"signed a purchase (?:agreement|contract) with\s+{peer}"),
    ("direct_participant", "partner", "partnership", (), "", LEAD + r"(?:signed a partnership with|partnered with)\s+{peer}"),
    ("direct_participant", "investor", "transaction", ("investment", "financing"), "", LEAD + r"(?:invested in|provided financing to)\s+{peer}"),
    ("direct_participant", "issuer", "transaction", ("financing",), "", LEAD + r"(?:issued (?:bonds|debt)|raised financing)\b"),
    ("direct_participant", "regulator", "regulation", ("regulation",), "", LEAD + r"(?:fined|sanctioned)\s+{peer}"),
    ("direct_participant", "legal_subject", "litigation", ("litigation",), "", LEAD + r"(?:sued|filed a lawsuit against)\s+{peer}"),
    ("supported_indirect", "unknown", "ownership", (), "", r"\s+is (?:a |the )?(?:subsidiary|parent company) of\s+{peer}"),
    ("supported_indirect", "unknown", "competition", (), "", r"\s+(?:competes with|is a competitor of)\s+{peer}"),
    ("supported_indirect", "unknown", "supply_contract", (), "", r"\s+(?:supplies|is a supplier of)\s+{peer}"),
    ("supported_indirect", "unknown", "platform_license", (), "", r"\s+licenses (?:its |a )?platform to\s+{peer}"),
)
UNCERTAIN = r"\b(may|might|rumou?r|unconfirmed|expects?|expected)\b"


def _whole(name: Column) -> Column:
    """A pattern for a whole name."""
    return F.concat(F.lit(r"(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))


def relation_holds() -> Column:
    """Whether the quote states the relation, over columns quote, name, peer, attribution, role, relation and event_type."""
    name, peer = _whole(F.col("name")), _whole(F.coalesce("peer", F.lit("")))
    found = F.lit(False)
    for attribution, role, relation, kinds, before, after in FRAMES:
        parts = [F.lit("(?i)")]
        for text, own in ((before, False), (None, True), (after, False)):
            if own:
                parts.append(name)
                continue
            pieces = text.split("{peer}")
            for k, piece in enumerate(pieces):
                parts += [F.lit(piece), peer] if k + 1 < len(pieces) else [F.lit(piece)]
        there = F.col("peer").isNotNull() if "{peer}" in before + after else F.lit(True)
        kind = F.col("event_type").isin(*kinds) if kinds else F.lit(True)
        here = (F.col("attribution") == attribution) & (F.col("role") == role) & (F.col("relation") == relation) & there & kind
        found = found | (here & F.rlike("quote", F.concat(*parts)))
    return F.coalesce(found, F.lit(False))


def attribution_faults(mentions: DataFrame) -> DataFrame:
    """mentions with faults (array): why an attribution isn't supported by its quote.

    Beside relation_holds' columns: state (reported, uncertain, negated, unknown).
    """
    context = F.col("attribution").isin("contextual_mention", "unknown")
    claims = (F.col("role") != "unknown") | (F.col("relation") != "unknown") | F.col("peer").isNotNull() | (F.col("state") != "unknown")
    uncertain, negated = F.lower("quote").rlike(UNCERTAIN), F.lower("quote").rlike(NEGATED)
    rules = [
        (context & claims, "contextual_participation_forbidden"),
        (~context & (F.col("quote").isNull() | (F.col("state") == "unknown")), "attribution_evidence_required"),
        (~context & (F.lower("peer") == F.lower("name")), "attribution_not_explicit"),
        (~context & ((uncertain & (F.col("state") == "reported")) | (negated & (F.col("state") != "negated"))), "attribution_state_conflict"),
        (~context & F.col("quote").isNotNull() & ~relation_holds(), "relation_not_stated"),
    ]
    listed = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(fault)) for bad, fault in rules])
    return mentions.withColumn("faults", F.filter(listed, lambda x: x.isNotNull()))


def consumer_view(mentions: DataFrame) -> DataFrame:
    """What consumers may see: a ticker only for a reported direct participant of a confirmed event that isn't negated."""
    took_part = (F.col("attribution") == "direct_participant") & (F.col("state") == "reported") & (F.col("event_state") == "confirmed") & ~F.col("negated")
    return mentions.select("mention_id", "name", "attribution", took_part.alias("reported_participant"), F.when(took_part & F.col("resolved"), F.col("ticker")).alias("economic_ticker"))
