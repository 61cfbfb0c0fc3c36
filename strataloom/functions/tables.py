"""Fixed values that results depend on."""

from __future__ import annotations

# Multi-part terms and their plain words, applied in this order.
COMPOUND_TERMS = (
    ("block.timestamp", " time "),
    ("block.number", " block height "),
    ("msg.sender", " caller "),
    ("msg.value", " amount sent "),
    ("msg.data", " calldata "),
    ("tx.origin", " originator "),
)

# Operators and their words, applied in this order (longest first).
OPERATOR_WORDS = (
    ("<<=", " shift left "), (">>=", " shift right "), ("==", " equal "), ("!=", " unequal "), ("<=", " less equal "), (">=", " greater equal "),
    ("&&", " and "), ("||", " or "), ("<<", " shift left "), (">>", " shift right "), ("++", " increment "), ("--", " decrement "),
    ("+=", " increment "), ("-=", " decrement "), ("*=", " multiply "), ("/=", " divide "), ("%=", " modulo "), ("=>", " maps "),
    ("+", " add "), ("-", " subtract "), ("*", " multiply "), ("/", " divide "), ("%", " modulo "), ("=", " update "), ("<", " less "), (">", " greater "),
    ("!", " not "), ("&", " bitand "), ("|", " bitor "), ("^", " xor "), ("~", " bitnot "),
)

# Abbreviations.
ABBREVIATIONS = {
    "acc": "account", "acct": "account", "addr": "address", "amt": "amount", "arr": "array", "bal": "balance", "cfg": "config", "cnt": "count",
    "dest": "destination", "id": "identifier", "idx": "index", "init": "initialize", "len": "length", "msg": "message", "num": "number",
    "prev": "previous", "qty": "quantity", "recv": "receive", "ref": "reference", "src": "source", "tmp": "temporary", "tx": "transaction", "txn": "transaction",
}

# Stop words of the ranking tokeniser.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you "
    "your yours yourself yourselves".split()
)

# Words that never enter the simple-name index.
COMMON_WORDS = tuple("a an as at be by do for from if in is it no of on or so to up we".split())

# Openings that name a party.
PARTY_PREFIXES = (
    "an attacker", "a attacker", "the attacker", "an user", "a user", "the user", "a caller", "an caller", "the caller", "a miner", "the miner",
    "a validator", "the validator", "a sequencer", "the sequencer", "an admin", "a admin", "the admin", "the owner", "an owner", "a owner",
    "the operator", "an operator", "a operator", "the contract", "a contract", "an external party", "a counterparty", "the counterparty", "an actor",
    "a malicious", "the malicious",
)

# Openings that recommend something.
RECOMMENDATION_PREFIXES = ("add ", "use ", "implement ", "include ", "insert ", "introduce ", "wrap with ", "wrap in ", "apply ", "enforce by ", "ensure by ")

# Keywords of the two source languages.
KEYWORDS = tuple(
    sorted(
        set(
            "if else for while do break continue return try catch revert throw function modifier constructor fallback receive returns public private internal "
            "external pure view payable constant immutable memory storage calldata contract interface library abstract is using import pragma mapping struct "
            "enum event error type true false new delete emit indexed anonymous virtual override assembly "
            "loop match fn mod use pub crate self super impl trait where const static let mut ref move async await as dyn extern in unsafe macro_rules".split()
        )
    )
)

# Operators of code text, longest first.
CODE_OPERATORS = tuple("<<= >>= ..= ... == != <= >= && || << >> += -= *= /= %= &= |= ^= ++ -- ** => :: -> .. + - * / % = < > & | ^ ! ~ ? : ; . ,".split())

# Fixed value: identifiers in prose: camelCase, snake_case, SCREAMING_SNAKE, an optional ().
CODE_REFERENCE = r"\b(?:[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*|[a-z_][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?:\(\))?"

# Edge kinds as (name, weight, both directions), in order of their numbers.
EDGE_KINDS = (
    ("ContainsMember", 1.0, True), ("ContainsLocal", 1.2, True), ("ContainsField", 1.0, True), ("Calls", 0.7, False), ("References", 0.5, False),
    ("Implements", 0.8, True), ("ProxyOf", 0.9, False), ("WritesState", 0.7, False), ("UsingFor", 0.5, True), ("ModifierApplied", 0.5, True),
    ("ErrorThrown", 0.4, False), ("EventEmitted", 0.4, False), ("Derives", 0.6, True), ("ReExports", 0.4, False), ("MutatesField", 0.7, False),
)

# Topic prefixes in order.
TOPIC_PREFIXES = ("N", "D", "C", "A", "S", "P", "Y")

# Severities and their rank; anything else is pending.
SEVERITIES = (("critical", 3), ("high", 2), ("medium", 1), ("low", 0))

# Ranking and resolution constants.
K1, B, LENGTH_FLOOR, MIN_SCORE, TOP_K = 1.2, 0.75, 0.75, 1.0, 10
DAMPING, ROUNDS = 0.85, 30
CHOICE_RATIO, MAX_SEED_DEPTH, MAX_RESOLUTION_ROUNDS, PARAMETER_BOOST, TOP_EDGES = 0.65, 6, 4, 2.0, 3
BATCH_SIZE = 5
