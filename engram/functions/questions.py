"""Question types by patterns, and the retrieval strategy of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type, strategy, confidence and patterns, in the order in which they are tried.
TYPES = [
    ("counting", "agentic_only", 0.95, [
        r"^how\s+many\s+(times?|books?|events?|people?|places?|days?)\s+", r"^list\s+(all\s+)?(the\s+)?(books?|events?|places?|activities?)",
        r"^what\s+are\s+all\s+(the\s+)?(books?|events?|places?)", r"^what\s+books?\s+has\s+\w+\s+read",
        r"^what\s+places?\s+has\s+\w+\s+(visited|been|camped|traveled)", r"^where\s+has\s+\w+\s+(been|visited|camped|traveled)",
        r"^what\s+events?\s+has\s+\w+\s+(attended|participated)",
    ]),
    ("event_temporal", "agentic_only", 0.9, [
        r"^when\s+did\s+\w+\s+(go|attend|visit|have|give|meet|run|sign|paint|read|write|make|do|start|finish|complete)\b",
        r"^when\s+is\s+\w+\s+(going|planning|scheduled)\b", r"^when\s+will\s+\w+\s+(go|attend|visit|have)\b",
        r"^what\s+time\s+did\s+\w+", r"^on\s+what\s+date\s+did\s+\w+",
    ]),
    ("event_activity", "gec_cluster_rerank", 0.85, [
        r"^what\s+activities?\s+does?\s+\w+\s+(do|partake|engage|participate)", r"^what\s+does?\s+\w+\s+do\s+to\s+(relax|destress|unwind)",
        r"^what\s+hobbies?\s+does?\s+\w+\s+have", r"^how\s+does?\s+\w+\s+spend\s+(time|days?|weekends?)",
    ]),
    ("event_aggregation", "gec_insert_after_hit", 0.8, [
        r"^what\s+(experiences?|activities)\s+(does?|has|did)\s+\w+\s+(have|do|partake)", r"^what\s+kinds?\s+of\s+\w+\s+(does?|has|did)\s+\w+",
    ]),
    ("attribute_identity", "agentic_only", 0.9, [
        r"^what\s+is\s+\w+['’]?s?\s+(identity|gender|orientation|status)", r"^who\s+is\s+\w+",
        r"^what\s+is\s+\w+['’]?s?\s+(relationship|marital)\s+status", r"^is\s+\w+\s+(married|single|dating|engaged)",
        r"^what\s+is\s+\w+['’]?s?\s+(job|occupation|profession)",
    ]),
    ("attribute_preference", "agentic_only", 0.8, [
        r"^what\s+does?\s+\w+\s+(like|prefer|enjoy|love|hate)", r"^what\s+is\s+\w+['’]?s?\s+favorite",
        r"^what\s+do\s+\w+['’]?s?\s+(kids?|children|family)\s+like", r"^what\s+kind\s+of\s+\w+\s+does?\s+\w+\s+(like|prefer)",
    ]),
    ("attribute_location", "agentic_only", 0.85, [
        r"^where\s+(is|does)\s+\w+\s+(from|live|work)", r"^where\s+did\s+\w+\s+(move|relocate|come)\s+from",
        r"^what\s+(city|country|state|town)\s+(is|does)\s+\w+", r"^where\s+is\s+\w+['’]?s?\s+(hometown|home|birthplace)",
    ]),
    ("reasoning_hypothetical", "gec_insert_after_hit", 0.75, [
        r"^would\s+\w+\s+(likely|still|ever|probably|pursue|want|choose|prefer)", r"^if\s+\w+\s+(had|didn['’]t|hadn['’]t|were|wasn['’]t)",
        r"^could\s+\w+\s+(have|be)\s+", r"^might\s+\w+\s+(have|be)\s+", r"^do\s+you\s+think\s+\w+\s+would",
    ]),
    ("time_calculation", "agentic_only", 0.8, [
        r"^how\s+long\s+(ago|has)\s+", r"^how\s+many\s+(years?|months?|days?|weeks?)\s+(ago|since|has)",
        r"^for\s+how\s+long\s+has\s+\w+", r"^\w+['’]?s?\s+\w+\s+birthday",
    ]),
    ("general", "gec_insert_after_hit", 0.6, [
        r"^what\s+(career|field|job|profession)\s+(path|would|has|did)\s+\w+", r"^what\s+fields?\s+(would|will|did)\s+\w+\s+(pursue|study|choose)",
        r"^what\s+did\s+\w+\s+(research|study|major)",
    ]),
]
OTHERS = ("general", "gec_insert_after_hit", 0.3)


def classify(question: Column) -> Column:
    """Struct of type, strategy and confidence: of the first type with a pattern that is found."""
    given = lambda t: F.struct(*[F.lit(v).alias(n) for v, n in zip(t, ("type", "strategy", "confidence"), strict=True)])
    text = F.trim(question)
    found = None
    for *kind, patterns in TYPES:
        fits = F.regexp_like(text, F.lit("(?iU)" + "|".join(patterns)))
        found = F.when(fits, given(kind)) if found is None else found.when(fits, given(kind))
    return found.otherwise(given(OTHERS))


def route(kind: Column, overrides: dict[str, str] | None = None, known: list[str] | None = None, default: str = "gec_insert_after_hit") -> Column:
    """The strategy of a classify() struct: an override of its type if known, else its own if known, else the default."""
    known = known or ["agentic_only", "gec_insert_after_hit", "gec_cluster_rerank"]
    usable = {k: v for k, v in (overrides or {}).items() if v in known}
    own = F.when(kind["strategy"].isin(known), kind["strategy"])
    if not usable:
        return F.coalesce(own, F.lit(default))
    named = F.create_map(*[F.lit(x) for kv in usable.items() for x in kv])
    return F.coalesce(F.try_element_at(named, kind["type"]), own, F.lit(default))
