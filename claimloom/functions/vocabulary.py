"""Closed vocabularies. All of these are fixed values of the domain."""

from __future__ import annotations

# Grievance types in the order in which labels are looked for.
GRIEVANCE_TYPES = ("cancellation", "delay", "denied_boarding", "downgrade")

# Scenario types and rule families a rule may carry.
SCENARIO_TYPES = (
    "denied_boarding",
    "cancellation",
    "delay",
    "downgrade",
    "cross_cutting",
)
ANY_SCENARIO = "cross_cutting"
RULE_FAMILIES = ("entitlement", "exception", "facility")
DEFAULT_FAMILY = "entitlement"

# Types for which a compensation letter is offered.
LETTER_TYPES = ("cancellation", "denied_boarding")

# Words that make a message flight-related.
FLIGHT_WORDS = (
    "flight", "flights", "airline", "airlines", "airport",
    "cancellation", "cancelled", "cancel", "canceling",
    "delay", "delayed", "delaying",
    "boarding", "boarded", "denied boarding",
    "downgrade", "downgraded", "class change",
    "refund", "compensation", "ticket",
    "indigo", "air india", "spicejet", "vistara", "go first", "akasa",
)

# Section keywords per group; a group counts when its name occurs
# in the question.
SECTION_KEYWORDS = {
    "cancel": ("cancellation", "cancel", "refund"),
    "delay": ("delay", "postpone", "late"),
    "denied": ("denied boarding", "denied", "overbooking", "bumping"),
    "downgrade": ("downgrade", "class", "upgrade"),
    "compensation": ("compensation", "refund", "payment", "reimburse"),
    "refund": ("refund", "money back", "reimbursement"),
    "baggage": ("baggage", "luggage", "bag"),
    "facility": ("facilities", "refreshment", "meal", "hotel", "accommodation"),
}
SECTION_KEYWORD_WEIGHT = 10

# Text around a packed context.
CONTEXT_HEADING = "=== DGCA REGULATIONS CONTEXT ===\n\n"
CONTEXT_NOTE = (
    "\n[Note: For specific queries, please refer to the complete DGCA Civil "
    "Aviation Requirements]\n"
)

# Indicators of a field's type, looked for in the name and then in
# the description, type by type in this order.
FIELD_TYPE_INDICATORS = (
    ("boolean", ("_confirmed", "is_", "has_", "was_"), ("yes/no", "true/false")),
    (
        "number",
        ("_hours", "_km", "_minutes", "distance", "delay", "amount", "fare", "price"),
        ("number", "amount"),
    ),
    ("datetime", ("_date", "_time", "datetime", "timestamp"), ("date", "time")),
)

# Display labels.
TYPE_LABELS = {
    "cancellation": "Flight Cancellation",
    "delay": "Flight Delay",
    "denied_boarding": "Denied Boarding",
    "downgrade": "Class Downgrade",
}

# Our own keywords for the rule-based classifier, tried in this order.
CLASSIFIER_KEYWORDS = (
    ("denied_boarding", ("denied_boarding", "denied boarding", "oversold", "overbook")),
    ("downgrade", ("downgrade", "lower class")),
    ("cancellation", ("cancel",)),
    ("delay", ("delay", "hours late", "still waiting")),
)
