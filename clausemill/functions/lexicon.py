"""Weighted phrase lexicons, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """Phrases and weights; modals match tokens, everything else matches substrings of lower-cased text."""

    modals: dict[str, float]
    consequences: dict[str, float]
    conditionals: dict[str, float]
    up: dict[str, float] = field(default_factory=dict)
    down: dict[str, float] = field(default_factory=dict)
    seeds: tuple[str, ...] = ()
    negations: tuple[str, ...] = ()
    obligations: tuple[str, ...] = ()

    def rows(self) -> list[tuple[str, int, str, float]]:
        """(kind, ord, phrase, weight) rows of the lexicon table."""
        kinds = (("modal", self.modals), ("consequence", self.consequences), ("conditional", self.conditionals), ("up", self.up), ("down", self.down))
        return [(kind, i, phrase, float(w)) for kind, words in kinds for i, (phrase, w) in enumerate(words.items())]


# The policy lexicon for risk scores.
POLICY = Lexicon(
    modals={
        "must": 0.9, "shall": 0.9, "obliged": 0.9, "obligated": 0.9, "mandated": 0.9, "will": 0.8, "required": 0.8,
        "should": 0.6, "ought": 0.6, "expected": 0.6, "necessary": 0.6, "may": 0.3, "can": 0.3, "could": 0.3, "might": 0.2,
        "allowed": 0.3, "permitted": 0.3, "encouraged": 0.1, "recommended": 0.1, "suggested": 0.1, "optional": 0.1,
    },
    consequences={
        "termination": 1.0, "terminated": 1.0, "terminate": 1.0, "dismissal": 1.0, "dismissed": 1.0, "dismiss": 1.0,
        "expulsion": 1.0, "expelled": 1.0, "expel": 1.0, "disqualification": 1.0, "disqualified": 1.0,
        "imprisonment": 1.0, "prosecution": 1.0, "prosecuted": 1.0, "criminal": 0.95, "conviction": 1.0, "convicted": 1.0,
        "revocation": 0.95, "revoked": 0.95, "injunction": 0.95, "litigation": 0.95, "lawsuit": 0.95,
        "legal action": 1.0, "law enforcement": 1.0, "indemnify": 0.9, "indemnification": 0.9, "indemnif": 0.9,
        "damages": 0.85, "penalty": 0.85, "penalties": 0.85, "fine": 0.85, "fined": 0.85, "sanction": 0.85, "sanctions": 0.85,
        "banned": 0.9, "ban": 0.9, "barred": 0.9, "debarred": 0.9, "blacklisted": 0.9, "void": 0.9, "liable": 0.85, "liability": 0.85,
        "breach": 0.8, "default": 0.8, "infringement": 0.85, "infringe": 0.85, "misappropriation": 0.9,
        "arbitration": 0.85, "arbitrate": 0.85, "injunctive": 0.9, "equitable relief": 0.9, "liquidated damages": 0.95,
        "consequential damages": 0.9, "specific performance": 0.85, "material breach": 0.8, "material default": 0.8,
        "suspension": 0.75, "suspended": 0.75, "probation": 0.7, "disciplinary": 0.7, "investigation": 0.65, "investigated": 0.65,
        "formal warning": 0.7, "written warning": 0.7, "prohibited": 0.7, "prohibit": 0.7, "restriction": 0.65, "restricted": 0.65,
        "withhold": 0.65, "withheld": 0.65, "loss of": 0.7, "forfeiture": 0.75, "forfeit": 0.7, "corrective action": 0.65,
        "performance plan": 0.6, "remedies": 0.65, "remedy": 0.6, "notice of breach": 0.75, "not permitted": 0.55, "not allowed": 0.55,
        "warning": 0.5, "warned": 0.5, "deduction": 0.45, "deducted": 0.45, "monitor": 0.4, "monitored": 0.4, "hold": 0.4, "freeze": 0.4,
        "reprimand": 0.5, "caution": 0.45, "obligation": 0.45, "obligations": 0.45, "covenant": 0.45, "covenants": 0.45,
        "warranty": 0.45, "warranties": 0.45, "represent and warrant": 0.5, "comply": 0.4, "compliance": 0.4,
        "inform": 0.2, "remind": 0.15, "advise": 0.15, "note": 0.1, "consider": 0.1, "encourage": 0.1, "recommend": 0.1, "suggest": 0.1,
        "guidance": 0.1, "discretion": 0.2, "acknowledge": 0.15, "agrees": 0.2, "agree": 0.2,
    },
    conditionals={
        "failure to": 1.0, "failure of": 1.0, "non-compliance": 1.0, "noncompliance": 1.0, "in violation": 1.0, "violation of": 1.0,
        "breach of": 1.0, "in breach": 0.95, "liable for": 0.95, "liable to": 0.9, "result in": 0.85, "results in": 0.85,
        "constitute": 0.8, "constitutes": 0.8, "give rise to": 0.85, "in the event of": 0.85, "without authorization": 0.85,
        "without consent": 0.85, "without notice": 0.85, "strictly prohibited": 0.95, "is prohibited": 0.9, "must not": 0.85,
        "shall not": 0.85, "zero tolerance": 1.0, "upon breach": 0.8, "upon default": 0.75, "without prior written": 0.8,
        "if terminated": 0.75, "if breached": 0.75, "upon termination": 0.75, "unless": 0.5, "provided that": 0.6, "may result": 0.6,
        "could result": 0.6, "in the event": 0.6, "notwithstanding": 0.55, "in case of": 0.55, "subject to approval": 0.5,
        "unless otherwise": 0.55, "except as": 0.45, "without written": 0.65, "where possible": 0.15, "at discretion": 0.2,
        "where applicable": 0.15, "as appropriate": 0.15, "may be waived": 0.1, "where relevant": 0.15,
    },
    up={
        "immediate": 1.3, "immediately": 1.3, "permanent": 1.3, "permanently": 1.3, "gross": 1.3, "gross misconduct": 1.35,
        "serious": 1.25, "severe": 1.25, "significant": 1.2, "strict": 1.2, "strictly": 1.2, "automatic": 1.25, "automatically": 1.25,
        "mandatory": 1.2, "without exception": 1.3, "regardless": 1.15, "unconditional": 1.2, "per violation": 1.25,
        "each violation": 1.25, "willful": 1.25, "wilful": 1.25, "deliberate": 1.2, "repeated": 1.2,
    },
    down={
        "minor": 0.7, "minimal": 0.75, "incidental": 0.75, "reasonable": 0.8, "where practicable": 0.7, "at discretion": 0.75,
        "may be waived": 0.65, "generally": 0.85, "typically": 0.85, "where possible": 0.75, "informal": 0.7, "verbal": 0.75,
        "first offence": 0.8, "first offense": 0.8, "advisory": 0.65, "informational": 0.6, "optional": 0.6, "encouraged": 0.65,
        "recommended": 0.7,
    },
    seeds=(
        "termination of employment", "immediate dismissal", "criminal prosecution", "legal action", "subject to termination",
        "gross misconduct", "result in dismissal", "result in expulsion", "disqualified from", "referred to law enforcement",
        "without prior notice", "shall be terminated", "may be prosecuted", "liable for damages", "regulatory fine",
        "enforcement action", "permanent exclusion", "academic misconduct", "failure to comply", "breach of contract",
        "in violation of", "subject to disciplinary", "loss of privileges", "suspension without pay", "written warning issued",
        "zero tolerance policy", "data breach notification", "strictly prohibited", "must not disclose", "shall not be",
        "non-compliance may result", "violation of this policy",
    ),
)

# The smaller lexicon for classifier features.
FEATURES = Lexicon(
    modals={"must": 0.9, "shall": 0.9, "will": 0.8, "required": 0.8, "should": 0.6, "may": 0.3, "can": 0.3, "encouraged": 0.1, "optional": 0.1},
    consequences={
        "termination": 1.0, "dismissal": 1.0, "criminal": 0.95, "imprisonment": 1.0, "prosecution": 1.0, "damages": 0.85, "penalty": 0.85,
        "fine": 0.85, "suspension": 0.75, "prohibited": 0.7, "disciplinary": 0.7, "breach": 0.8, "liable": 0.85, "liability": 0.85,
        "sanction": 0.85, "warning": 0.5, "deduction": 0.45, "comply": 0.4, "obligation": 0.45,
    },
    conditionals={
        "failure to": 1.0, "violation of": 1.0, "breach of": 1.0, "result in": 0.85, "constitute": 0.8, "shall not": 0.85, "must not": 0.85,
        "in the event of": 0.85, "without consent": 0.85, "may result": 0.6, "provided that": 0.6, "unless": 0.5,
    },
    negations=("must not", "shall not", "not permitted", "not allowed", "without consent", "without authorization", "strictly prohibited"),
    obligations=("must", "shall", "will", "required"),
)

#: A lexicon over words of the synthetic test documents.
FIXTURE = Lexicon(
    modals={"the": 0.9, "is": 0.6, "was": 0.3},
    consequences={"of the": 1.0, "with": 0.7, "that": 0.45, "for": 0.2},
    conditionals={"in the": 1.0, "is the": 0.85, "to the": 0.5},
    up={"this": 1.3},
    down={"by": 0.7},
    seeds=("of the", "with"),
    negations=("is not", "in the"),
    obligations=("the", "is"),
)

#: Severity, badge and order of the labels; words that stop-word removal keeps.
LABELS = ("Critical", "High", "Medium", "Low")
SEVERITY = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
BADGE = {"Critical": "critical", "High": "high", "Medium": "medium", "Low": "low"}
KEEP_WORDS = ("must", "shall", "may", "should", "will", "not", "no", "without", "unless", "except", "never", "only", "immediately", "prohibited", "required", "mandatory", "forbidden")
