"""Text functions as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: British spellings and their American forms, tried in this order on any case.
AMERICAN = {
    "leukaemia": "leukemia",
    "tumour": "tumor",
    "haemato": "hemato",
    "oedema": "edema",
    "paediatric": "pediatric",
    "foetal": "fetal",
    "anaemia": "anemia",
    "haemoglobin": "hemoglobin",
    "gynaecolog": "gynecolog",
    "diarrhoea": "diarrhea",
}
NULL_WORDS = ("", "nan", "NaN", "None")
NOISE = frozenset(
    ["na", "n a", "no", "yes", "none", "true", "false", "other", "missing", "pending", "unknown", "negative", "positive"]
    + ["undetermined", "uninformative", "not applicable", "not available", "not evaluated", "not reported"]
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Units and dosing marks, by kind.
UNITS = "|".join(
    [r"\b(?:iv|po|sc|iu|gy|qd|bid|tid|mcg|mmhg|u/ml|icd-10)\b", r"\bmg(?:/m[2²])?\b", r"\bauc\d+\b", r"\bq\d+[dw]\b", r"\bd\d+(?:[-,]\d+)*\b", r"\bx\d+\s*cycles?\b", r"\bµg\b", r"\b%\b"]
)
DOSE_TAG = r"(?i)auc\d+|gy|mg\b|mg/m[2²]"
DOSE = r"(?i)\b(?:auc|cycle|dose|gy|m[2²]|mg|ml|regimen)\b"
AGE = r"(?i)\b(?:age|age[_\s-]?at|diagnosis[_\s-]?age)\b"
TIME = r"(?i)\b(?:date|days?|duration|end|freq(?:uency)?|interval|months?|start|years?)\b"
FAMILIES = {
    "dose": [(("dose",), 0.15), (("treatment_number", "cycle", "auc", "unit"), 0.10)],
    "age": [(("age",), 0.15)],
    "time": [(("date", "start", "end", "duration", "frequency", "time"), 0.15)],
}
TREATMENT = ("chemo", "drug", "radiation", "regimen", "surgery", "therapy", "treatment")
#: Prefixes of codes and their ontologies; codes without a prefix are NCIt's.
ONTOLOGIES = {
    "NCIT": "ncit", "UBERON": "uberon", "MONDO": "mondo", "EFO": "efo", "HP": "hp", "DOID": "doid",
    "CL": "cl", "CHEBI": "chebi", "GO": "go", "PATO": "pato", "OBI": "obi", "NCBITAXON": "ncbitaxon",
}
IRIS = {"efo": "http://www.ebi.ac.uk/efo/"}
PURL = "http://purl.obolibrary.org/obo/"


def key(c: Column) -> Column:
    """What labels are compared by: trimmed lower case."""
    return F.lower(F.trim(c))


def normalize(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else one space."""
    return F.trim(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")))


def clean_query(c: Column) -> Column:
    """Trimmed; words that mean null become null."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin(*NULL_WORDS), t)


def valid_values(cell: Column) -> Column:
    """The values of a cell with several (``;``, ``<;>``, ``::``), without blanks and NA."""
    valid = lambda x: (x != "") & (F.lower(x) != "na") & ~x.isin("<", ">")
    one = F.when(valid(F.trim(cell)), F.array(F.trim(cell))).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.transform(F.split(cell, ";|<;>|::"), lambda x: F.trim(x)), valid)
    return F.when(~cell.contains(";") & ~cell.contains("::"), one).otherwise(parts)  # most cells have one value, and need no pattern


def enum_values(cell: Column) -> Column:
    """The choices of an enumeration cell (``|``), without blanks and NA."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & (x != "NA"))


def is_pattern(allowed: Column) -> Column:
    """Whether a cell of allowed values is a regular expression."""
    t = F.trim(allowed)
    return t.rlike(r"^\^") | t.rlike(r"\$$") | t.rlike(r"[\[\]{}+]")


def american(c: Column) -> Column:
    """Underscores to spaces, British spellings to American ones."""
    c = F.regexp_replace(c, "_", " ")
    for british, word in AMERICAN.items():
        c = F.regexp_replace(c, f"(?i){british}", word)
    return F.trim(c)


def singular(c: Column) -> Column:
    """Without the s at its end, if there is more than three letters; else null."""
    return F.when(F.lower(c).endswith("s") & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1))


def clean_code(curie: Column) -> Column:
    """``NCIT:C1`` is ``C1``, any other ``P:1`` is ``P_1``."""
    p, rest = F.split_part(curie, F.lit(":"), F.lit(1)), F.substring_index(curie, ":", -1)
    return F.when(~F.contains(curie, F.lit(":")), curie).when(F.upper(p) == "NCIT", rest).otherwise(F.concat(p, F.lit("_"), rest))


def obo_id(code: Column) -> Column:
    """``P_1`` is ``P:1``; what has a colon stays."""
    t = F.trim(code)
    return F.when(F.contains(t, F.lit(":")), t).otherwise(F.regexp_replace(t, "^([^_:]+)_", "$1:"))


def ontology(code: Column) -> Column:
    """Ontology of a clean code; null for unknown prefixes. Codes without a prefix are ncit's."""
    prefix = F.upper(F.split_part(code, F.lit("_"), F.lit(1)))
    known = F.create_map(*(F.lit(x) for pair in ONTOLOGIES.items() for x in pair if pair[0] != "NCIT"))
    return F.when(~F.contains(code, F.lit("_")), F.lit("ncit")).otherwise(known[prefix])


def iri(code: Column) -> Column:
    """The IRI of a clean code."""
    base = F.when(ontology(code) == "efo", F.lit(IRIS["efo"])).otherwise(F.lit(PURL))
    return F.concat(base, F.when(F.contains(code, F.lit("_")), code).otherwise(F.concat(F.lit("NCIT_"), code)))


def abbreviation(code: Column) -> Column:
    """Key of a code among abbreviations."""
    return F.lower(F.regexp_replace(F.trim(code), "_", " "))


def without_units(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i){UNITS}", " "), r"\s+", " "))


def unit_tags(c: Column) -> Column:
    """The distinct units in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i)({UNITS})"), F.lit(1))))


def numeric_family(header: Column, tags: Column) -> Column:
    """dose, age, time or unknown."""
    header = F.coalesce(header, F.lit(""))
    dosed = F.exists(tags, lambda t: t.rlike(DOSE_TAG)) | header.rlike(DOSE)
    return F.when(dosed, "dose").when(header.rlike(AGE), "age").when(header.rlike(TIME), "time").otherwise("unknown")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def family_boost(field: Column, family: Column) -> Column:
    field, out = F.lower(F.coalesce(field, F.lit(""))), None
    for name, rules in FAMILIES.items():
        for words, bonus in rules:
            test = (family == name) & _any(field, words)
            out = F.when(test, bonus) if out is None else out.when(test, bonus)
    return out.otherwise(0.0).cast("double")


def treatment_boost(field: Column, column: Column) -> Column:
    treated = column.rlike("(^tx_|_tx$|_tx_)") | _any(column, TREATMENT)
    return F.when(treated & F.contains(F.lower(field), F.lit("treatment")), 0.2).otherwise(0.0).cast("double")


def is_number(c: Column) -> Column:
    """Whether a text is a decimal number (inf and nan are not)."""
    return c.rlike(NUMBER)


def yes_flag(c: Column) -> Column:
    """``yes`` for yes, true, 1; else empty."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin("yes", "true", "1"), "yes").otherwise("")


def log_weight(share: Column) -> Column:
    return F.log1p(share * 10)


def column_text(name: Column) -> Column:
    """A column name as words."""
    return F.trim(F.regexp_replace(name, "[-_.:]", " "))


def tokens(name: Column) -> Column:
    """The lower-case words of a name, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(name), "[-_.:]", " "), r"\s+"), lambda t: t != "")


def embed_text(name: Column, values: Column, top: int = 5, longest: int = 30) -> Column:
    """``name: v1, v2``: a column's words and the first of its sorted, clipped values; null values give the words alone."""
    clipped = F.slice(F.array_sort(F.transform(values, lambda v: F.substring(v, 1, longest))), 1, top)
    return F.when(F.size(values) > 0, F.concat(column_text(name), F.lit(": "), F.array_join(clipped, ", "))).otherwise(column_text(name))


def score_text(score: Column) -> Column:
    return F.format_string("%.4f", score)


def pipe_set(cell: Column) -> Column:
    """The sorted distinct parts of a ``|`` cell; null and nan words give none."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin("", "nan", "none"))))


def rag_context(label: Column, definitions: Column, parents: Column, children: Column, most: int = 10) -> Column:
    """``label: definitions: … . parents: a; b. children: c``; the label alone if there is nothing else."""

    def part(name: str, items: Column) -> Column:
        kept = F.slice(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))), 1, most)
        return F.when(F.size(kept) > 0, F.concat(F.lit(f"{name}: "), F.array_join(kept, "; ")))

    said = F.transform(definitions, lambda d: F.regexp_replace(F.trim(d), r"[.;\s]+$", ""))
    rest = F.concat_ws(". ", part("definitions", said), part("parents", parents), part("children", children))
    return F.when(rest != "", F.concat(label, F.lit(": "), rest)).otherwise(label)


def concept_definitions(definitions: Column) -> Column:
    """Definitions without their ends ``.;`` and ``(NCI)``, the first of each wording, as the context of a concept."""
    plain = F.transform(definitions, lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(d), r"[.;\s]+$", ""), r"\s+", " "), r"(?i)[\s.;,:-]*\(?NCI\)?$", ""))
    plain = F.filter(plain, lambda d: d != "")
    return F.filter(plain, lambda d, i: ~F.exists(F.slice(plain, F.lit(1), i), lambda e: F.lower(e) == F.lower(d)))


ROLE_NOISE = r"^(Gene|Allele|EO_Disease|Biological_Process)_|^Molecular_Abnormality_Involves_Gene|^Cytogenetic_Abnormality_Involves_Chromosome|^Conceptual_Part_Of|^Chemotherapy_Regimen_Has_Component"


def role_name(role: Column) -> Column:
    """A role without its leading verb; null for roles that say nothing about the concept."""
    short = F.regexp_replace(role, "^((Disease|Procedure)_)?(Has_Accepted_Use_For|Mapped_To|May_Have|Excludes|Has|Is)?_?", "")
    return F.when(~role.rlike(ROLE_NOISE), short)


def enriched(term: Column, context: Column, most: int = 500) -> Column:
    """``term; Name: value; …`` from an array of (name, value), until most characters would be passed."""

    def add(text: Column, c: Column) -> Column:
        more = F.concat(text["s"], F.lit("; "), F.initcap(F.regexp_replace(c["name"], "_", " ")), F.lit(": "), F.trim(c["value"]))
        stop = text["full"] | (F.length(more) > most)
        return F.struct(F.when(stop, text["s"]).otherwise(more).alias("s"), stop.alias("full"))

    shown = F.filter(context, lambda c: c["value"].isNotNull() & ~F.lower(F.trim(c["value"])).isin("", "nan", "none", "na", "n/a", "null"))
    start = F.struct(F.trim(term).alias("s"), F.lit(False).alias("full"))
    return F.aggregate(shown, start, add, lambda t: t["s"])
