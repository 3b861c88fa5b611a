"""Fixed values of the tagging job: technique table and detection rules."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One detection rule: any matching pattern assigns the technique."""

    technique: str
    confidence: str
    patterns: tuple[str, ...]


# Technique id -> (name, tactic).
TECHNIQUES = {
    "T1110.001": ("Brute Force: Password Guessing", "Credential Access"),
    "T1046": ("Network Service Scanning", "Discovery"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1059.001": ("Command and Scripting: PowerShell", "Execution"),
    "T1059.007": ("Command and Scripting: JavaScript/XSS", "Execution"),
    "T1071.001": ("Application Layer Protocol: Web (C2)", "Command and Control"),
    "T1078": ("Valid Accounts", "Defense Evasion / Persistence"),
    "T1053.005": ("Scheduled Task/Job", "Persistence"),
    "T1055.012": ("Process Injection: LSASS", "Defense Evasion / Privilege Escalation"),
    "T1087.002": ("Account Discovery: Domain Account", "Discovery"),
    "T1562.001": ("Impair Defenses: Disable/Clear Logs", "Defense Evasion"),
    "T1052.001": ("Exfiltration over Physical Medium: USB", "Exfiltration"),
}

# Rank of a rule's confidence, higher wins.
CONFIDENCE_RANK = {"HIGH": 2, "MEDIUM": 1, "LOW": 0}

# Detection rules in table order; patterns ignore case.
RULES = (
    Rule("T1110.001", "HIGH", (
        r"failed password",
        r"authentication failure",
        r"invalid user",
        r"failed login",
        r"bad password",
        r"EventID=4625",
        r"Login attempt.*fail",
    )),
    Rule("T1046", "HIGH", (
        r"port.?scan",
        r"\d+ ports? in \d+",
        r"nmap",
        r"masscan",
        r"scan sweep",
        r"SYN flood",
    )),
    Rule("T1190", "HIGH", (
        r"sql.?inject",
        r"union.{0,10}select",
        r"1=1",
        r"xp_cmdshell",
        r"exploit",
        r"CVE-\d{4}-\d+",
        r"RCE",
        r"remote code",
        r"\.\.\/",
        r"wp-login\.php.*POST",
    )),
    Rule("T1059.001", "HIGH", (
        r"powershell",
        r"-[Ee]nc(odedCommand)?",
        r"-[Ee]xecutionPolicy",
        r"IEX\s*\(",
        r"Invoke-Expression",
        r"downloadstring",
        r"EventID=4688.*powershell",
    )),
    Rule("T1059.007", "MEDIUM", (
        r"<script",
        r"javascript:",
        r"onerror=",
        r"XSS",
        r"cross.site",
    )),
    Rule("T1071.001", "HIGH", (
        r"185\.220\.101\.",
        r"91\.108\.\d+\.",
        r"beacon",
        r"C2",
        r"cobalt.?strike",
        r"meterpreter",
        r"reverse.?shell",
        r"outbound.*443.*suspicious",
    )),
    Rule("T1078", "MEDIUM", (
        r"EventID=4624",
        r"EventID=4648",
        r"accepted password",
        r"successful.*login",
        r"vpn.*login.*unusual",
        r"geo.*login",
    )),
    Rule("T1053.005", "HIGH", (
        r"EventID=4698",
        r"scheduled task.*creat",
        r"schtasks",
        r"crontab",
        r"persistence.*task",
    )),
    Rule("T1055.012", "HIGH", (
        r"lsass",
        r"process.?inject",
        r"process.?hollow",
        r"memory.?inject",
        r"credential.?dump",
        r"mimikatz",
    )),
    Rule("T1087.002", "MEDIUM", (
        r"ldap.*objectclass",
        r"net user",
        r"net group",
        r"domain.*enum",
        r"AD dump",
        r"EventID=4769",
    )),
    Rule("T1562.001", "HIGH", (
        r"EventID=1102",
        r"audit log.*clear",
        r"log.*delet",
        r"wevtutil.*cl",
    )),
    Rule("T1052.001", "MEDIUM", (
        r"removable media",
        r"usb.*transfer",
        r"external.*drive",
        r"\d+\.\d+ GB.*cop",
    )),
)

# The pattern "RCE" also matches inside the word "source"; this variant asks for whole words.
WORD_BOUNDED_RULES = tuple(
    Rule(r.technique, r.confidence, tuple(r"\bRCE\b" if p == "RCE" else p for p in r.patterns))
    for r in RULES
)
