"""Settings, and the closed lists that decide results."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Settings:
    """Tunables of the memory engine. The clock is never one of them: operators take now_ms."""

    consolidation_threshold: float = 0.6
    decay_rate_per_day: float = 0.05
    consolidation_delay_ms: int = 3_600_000
    retention_days: int = 90
    forgotten_below: float = 0.1
    batch_size: int = 20
    rescore_limit: int = 50
    knn_candidates: int = 50
    fact_overfetch: int = 4
    dense_weight: float = 0.7
    sparse_weight: float = 0.3
    recency_weight: float = 0.1
    half_life_days: float = 30.0
    working_items: int = 5
    working_sessions: int = 100
    history_turns: int = 5
    fuzzy_cutoff: float = 0.75
    graph_episodes: int = 300
    canonical_subjects: dict[str, str] = field(default_factory=dict)


# Vocabularies and labels that stored facts and rendered answers have to match.
FUNCTIONAL = ("works_at", "lives_in")
MULTI = ("prefers", "dislikes", "owns", "is_a", "has_attribute", "knows_about", "has_goal", "has_skill")
FALLBACK = "has_attribute"
ENTITY_TYPES = ("person", "org", "place", "concept", "product")
ENTITY_LABELS = {"person": "personne", "org": "organisation", "place": "lieu"}
PREDICATE_LABELS = {
    "works_at": "travaille chez", "lives_in": "habite à", "prefers": "préfère", "dislikes": "n'aime pas", "owns": "possède",
    "is_a": "est", "has_attribute": "a pour trait", "knows_about": "connaît", "has_goal": "a pour objectif", "has_skill": "maîtrise",
}
LINK_FAMILIES = {
    "lives_in": "localisation", "works_at": "emploi", "is_a": "relation", "has_attribute": "relation", "prefers": "loisir",
    "dislikes": "loisir", "owns": "loisir", "knows_about": "loisir", "has_goal": "projet", "has_skill": "projet",
}
MONTHS = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")
# Predicates that may stand for one another when a reference fact is looked up, as recall figures count them.
PREDICATE_KIN = {
    "owns": ("owns", "has_attribute"),
    "is_a": ("is_a", "has_attribute", "has_skill", "works_at"),
    "has_goal": ("has_goal", "knows_about", "has_attribute"),
    "has_attribute": ("has_attribute", "prefers", "has_goal", "knows_about", "owns", "is_a"),
    "knows_about": ("knows_about", "has_skill", "has_goal", "has_attribute"),
    "has_skill": ("has_skill", "has_attribute", "knows_about", "is_a"),
    "prefers": ("prefers", "has_attribute"),
    "lives_in": ("lives_in",),
    "works_at": ("works_at", "is_a"),
    "dislikes": ("dislikes", "has_attribute"),
}
# Question types in order of precedence, with the expressions that mark them; they decide the route of a question.
QUESTION_PATTERNS = (
    ("working", (
        r"\boù (on )?(en )?est\b", r"\bon en est où\b", r"\brésume\b", r"\brécap", r"\bwhere (were|are) we\b", r"\bso far\b",
        r"\bcurrent (status|state)\b", r"\bcontexte (actuel|courant)\b", r"\bstatut actuel\b",
    )),
    ("procedural", (
        r"\bcomment (je |on |tu )?(fais|fait|faire)\b", r"\bcomment (envoyer|créer|lancer|configurer)\b",
        r"\bhow (do|can|should) (i|we|you)\b", r"\bhow to\b", r"\bquelle (est la )?procédure\b", r"\bmarche à suivre\b", r"\bsteps to\b",
    )),
    ("semantic_history", (
        r"\bévolué\b", r"\bévolution\b", r"\bhistorique\b", r"\ba changé\b", r"\bavant .*(maintenant|aujourd)",
        r"\bchanged? over time\b", r"\bhistory of\b", r"\bused to\b", r"\bdans le temps\b", r"\bau fil du temps\b",
    )),
    ("episodic_temporal", (
        r"\bhier\b", r"\bavant-hier\b", r"\bla (dernière|derniere) fois\b", r"\bquand\b", r"\baujourd'hui\b", r"\bce matin\b",
        r"\bce soir\b", r"\bcette semaine\b", r"\bla semaine (dernière|derniere|passée|passee)\b", r"\ble mois dernier\b",
        r"\brécemment\b", r"\brecemment\b", r"\byesterday\b", r"\blast (time|week|month|night)\b", r"\bwhen did\b",
        r"\bthis (week|morning|evening)\b", r"\brecently\b", r"\btoday\b",
    )),
    ("episodic_fuzzy", (
        r"\bj'ai dit quoi\b", r"\bqu'est[- ]ce que j'ai dit\b", r"\bj'ai dit\b", r"\bon a parlé de\b", r"\bje t'ai parlé\b",
        r"\bj'ai mentionné\b", r"\bwhat did i say\b", r"\bdid (we|i) (talk|speak) about\b", r"\bi mentioned\b", r"\bwhat did we discuss\b",
    )),
    ("semantic_fact", (
        r"\bqu'est[- ]ce que tu sais\b", r"\btu sais (quoi )?sur\b", r"\bc'est qui\b", r"\bc'est quoi\b", r"\bqui est\b",
        r"\bje (préfère|prefere) quoi\b", r"\bquel(le)? est (mon|ma|le|la)\b", r"\boù (j'habite|je bosse|je travaille)\b",
        r"\bwhat do you know about\b", r"\bwho is\b", r"\bwhat is (my|the)\b", r"\bwhat (do|does) .* (prefer|like)\b", r"\btell me about\b",
    )),
)


def canonical_subject(tenant: str, settings: Settings) -> str:
    return settings.canonical_subjects.get(tenant, tenant)
