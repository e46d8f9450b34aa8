"""Classifiers: list topics and eligibility, histogram buckets, evidence, citation labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MIN_STARS, SOURCE_STARS = 100, 50_000

#: Topics and the patterns that mean them, in order.
TOPICS = {
    "Meta directories": r"(?:list of (?:awesome )?lists|awesome lists|awesome-awesome|awesome indexes)",
    "Self-hosting & infrastructure": r"\b(self.host(?:ed|ing)?|devops|kubernetes|docker|infrastructure|cloud|homelab|sysadmin)\b",
    "AI & machine learning": r"\b(ai|llm|machine.learning|deep.learning|artificial.intelligence|agents|generative)\b",
    "Software development": r"\b(programming|development|developer|code|software|javascript|python|rust|java|typescript|golang|nodejs|cpp|dotnet)\b",
    "Data & analytics": r"\b(data|database|analytics|visualization|statistics|sql)\b",
    "Security & privacy": r"\b(security|privacy|hacking|pentest|cryptography|osint)\b",
    "Design & creativity": r"\b(design|creative|art|fonts|icons|animation|ux|ui|music)\b",
    "Learning & careers": r"\b(learn|learning|courses|education|interview|career|books|tutorials)\b",
    "Web & mobile": r"\b(web|frontend|front.end|react|vue|android|ios|mobile|flutter)\b",
    "Science & engineering": r"\b(science|scientific|engineering|robotics|mathematics|physics|biology|research)\b",
    "Productivity & life": r"\b(productivity|personal|life|health|travel|finance|business|work)\b",
    "Games & media": r"\b(games?|gaming|video|media|gamedev|unity|unreal)\b",
}
OTHER_TOPICS = "Other topics"
#: Patterns of a list's purpose in prose, of a description that names a list, of one that names a product,
#: and of a name.
PURPOSE = r"(?iu)(?:^|\n)\W*(?:(?:this|an?|the)\s+)?(?:is\s+)?(?:a\s+)?(?:(?:curated|opinionated|comprehensive|categorized|maintained|hand-picked|community-driven|sorted|awesome|useful|selected)\s+)*(?:list|collection|directory)\s+of\b"
NAMES_LIST = r"(?iu)^\W*(?:awesome|curated)\s+(?:[\w-]+\s+){0,5}(?:lists?|resources|collection)\b"
NAMES_PRODUCT = r"(?iu)^\W*(?:(?:this|an?|the)\s+)?(?:is\s+)?(?:a\s+)?(?:\w+[ -]+){0,4}(application|framework|library|toolkit|editor|window manager|browser extension|platform|control plane)\b"
OWN_NAME = r"(?iu)(?:^|[/_.-])awesome(?:$|[/_.-])"


def topics_of(text: Column) -> Column:
    """All topics whose pattern a text has, in the order above, or Other topics."""
    found = F.filter(F.array(*(F.when(text.rlike(f"(?iu){p}"), F.lit(t)) for t, p in TOPICS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_TOPICS)))


def eligibility(public: Column, stars: Column, unique_links: Column, name: Column, description: Column, labels: Column, readme: Column) -> Column:
    """struct<state, reason>. unique_links is null where no README was parsed. The first rule that holds decides."""
    description, readme = F.coalesce(description, F.lit("")), F.coalesce(readme, F.lit(""))
    introduction = F.substring(F.substring_index(readme, "\n## ", 1), 1, 2000)
    described = description.rlike(PURPOSE) | description.rlike(NAMES_LIST)
    named = F.coalesce(name, F.lit("")).rlike(OWN_NAME) | F.coalesce(F.arrays_overlap(labels, F.array(F.lit("awesome"), F.lit("awesome-list"))), F.lit(False))
    intent = described | (~description.rlike(NAMES_PRODUCT) & (named | introduction.rlike(PURPOSE)))
    said = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    # fixed values: the sentences of the reasons
    return (
        F.when(~F.coalesce(public, F.lit(False)), said("excluded", "Repository is not public."))
        .when(stars.isNull(), said("pending", "Star count is unavailable."))
        .when(stars < MIN_STARS, said("excluded", "Observed stars are below 100."))
        .when(unique_links.isNull(), said("pending", "README has not been parsed or its format is unsupported."))
        .when(intent & (unique_links >= 3), said("eligible", "Curated-list intent and at least three distinct supported content links observed."))
        .when(unique_links >= 5, said("pending", "Links found, but curated-list intent is uncertain; not silently excluded."))
        .when(intent, said("pending", "List intent found; insufficient supported README content (may use other files)."))
        .otherwise(said("excluded", "No curated-list intent and insufficient supported list content in inspected README."))
    )


def qualifies(stars: Column, public: Column, is_list: Column) -> Column:
    return F.coalesce((stars >= SOURCE_STARS) & public & is_list, F.lit(False))


#: Labels and lower limits; the next limit ends a bucket.
STAR_BUCKETS = (("100–499", 100), ("500–999", 500), ("1k–4.9k", 1_000), ("5k–9.9k", 5_000), ("10k–49.9k", 10_000), ("50k+", 50_000))
ENTRY_BUCKETS = (("1–24", 1), ("25–99", 25), ("100–299", 100), ("300–999", 300), ("1,000+", 1_000))


def bucket(value: Column, buckets) -> Column:
    """The label of the last lower limit that the value reaches; Unknown for null and for less than the first."""
    out = F.when(value.isNull() | (value < buckets[0][1]), "Unknown")
    for label, low in reversed(buckets):
        out = out.when(value >= low, label)
    return out


def bucket_rank(label: Column, buckets) -> Column:
    out = F.lit(len(buckets))
    for i, (name, _) in enumerate(buckets):
        out = F.when(label == name, i).otherwise(out)
    return out


def evidence(explicit: Column, similarity: Column) -> Column:
    """Of a pair of citations: copy by an explicit link or close titles, independent by distant ones, else ambiguous."""
    return F.when(explicit | (similarity >= 0.92), "copy-lineage").when(similarity < 0.60, "independent").otherwise("ambiguous")


def citation_kind(lists: Column, independent: Column) -> Column:
    return F.when(lists <= 1, "single").when(independent >= 2, "independent").otherwise("raw-only")


def citation_text(lists: Column, independent: Column) -> Column:
    kind = citation_kind(lists, independent)
    # fixed values: the three sentences
    return (
        F.when(kind == "single", F.lit("Listed in 1 source."))
        .when(kind == "independent", F.format_string("Cited independently by %d of %d listed sources (sibling/copy-lineage citations discounted; see methodology).", independent, lists))
        .otherwise(F.format_string("Listed in %d sources (citation text is shared/copy-lineage across them; not shown as an independence signal -- see methodology).", lists))
    )
