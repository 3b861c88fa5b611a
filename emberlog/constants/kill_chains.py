"""Fixed values of the correlation job."""

from dataclasses import dataclass


@dataclass(frozen=True)
class KillChain:
    """A named set of tactics that, seen together, raise an alert."""

    name: str
    tactics: tuple[str, ...]
    severity: str
    description: str


# The known kill chains, in table order.
KILL_CHAINS = (
    KillChain(
        "Full Intrusion Kill Chain",
        ("Initial Access", "Execution", "Command and Control"),
        "CRITICAL",
        "Complete attack sequence: initial compromise → code execution → C2 communication",
    ),
    KillChain(
        "Credential Theft & Persistence",
        ("Credential Access", "Defense Evasion", "Persistence"),
        "CRITICAL",
        "Attacker dumped credentials, cleared evidence, and established persistence",
    ),
    KillChain(
        "Lateral Movement Chain",
        ("Credential Access", "Lateral Movement", "Execution"),
        "CRITICAL",
        "Attacker using stolen credentials to spread across the network",
    ),
    KillChain(
        "Data Exfiltration Chain",
        ("Discovery", "Collection", "Exfiltration"),
        "HIGH",
        "Attacker discovered data, collected it, and is exfiltrating",
    ),
    KillChain(
        "Recon to Exploit",
        ("Discovery", "Initial Access"),
        "HIGH",
        "Network scanning followed by exploitation attempt",
    ),
)

# Share of a chain's tactics that must be present (two of three is not enough).
MIN_MATCH = 0.67

# Reach of the neighbour links and their weights.
SAME_IP_REACH = 14
SAME_TACTIC_REACH = 7
SAME_IP_WEIGHT = 1.0
SAME_TACTIC_WEIGHT = 0.7
ESCALATION_WEIGHT = 1.5

# Addresses that never link events.
UNLINKED_ADDRESSES = ("unknown", "0.0.0.0")
