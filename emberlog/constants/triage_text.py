"""Fixed values of the triage job: answer texts, prompt texts and rubric points.

``{ip}`` and ``{score}`` in a text are replaced per event.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Verdict:
    """One branch of a triage cascade; empty words mean the branch goes by score or is the last."""

    words: tuple[str, ...]
    threat_type: str
    explanation: str
    attacker_intent: str
    risk: str
    recommendations: tuple[str, ...]
    false_positive_probability: float


# Score from which an event without known words is a strong anomaly.
ANOMALY_SCORE = 0.75

# Cascade v1, first branch with a matching word wins.
CASCADE_V1 = (
    Verdict(
        ("sql", "inject", "union select", "1=1", "xp_cmdshell"),
        "SQL Injection (T1190)",
        "Attacker from {ip} injecting SQL code into web inputs to bypass authentication or dump database contents. Automated tooling confirmed by pattern.",
        "Steal credentials, dump database, or gain admin access.",
        "Full database compromise — all user data and passwords exposed.",
        ("Block {ip} at WAF immediately", "Audit all DB queries last 24h", "Check for successful auth bypasses"),
        0.03,
    ),
    Verdict(
        ("failed password", "invalid user", "authentication failure", "4625"),
        "Brute Force Attack (T1110.001)",
        "Automated credential stuffing from {ip} at machine speed. High failure rate confirms scripted tool cycling through password lists.",
        "Find valid credentials for initial system access.",
        "Account compromise leads to lateral movement across the network.",
        ("Block IP {ip} at firewall immediately", "Enable account lockout after 5 attempts", "Enforce MFA on all external services"),
        0.02,
    ),
    Verdict(
        ("powershell", "-enc", "encodedcommand", "invoke-expression", "iex("),
        "Encoded PowerShell (T1059.001)",
        "Base64-encoded PowerShell command detected — obfuscation technique to hide malicious payload from signature-based AV and EDR tools.",
        "Execute malware, establish reverse shell, or create persistence while evading detection.",
        "Malware installation or backdoor deployment on this host.",
        ("Decode and analyse the Base64 payload immediately", "Isolate affected host from network", "Enable PowerShell Script Block Logging via GPO"),
        0.07,
    ),
    Verdict(
        ("lsass", "credential dump", "mimikatz", "procdump"),
        "LSASS Credential Dump (T1055.012)",
        "LSASS process memory being read — contains plaintext passwords and NTLM hashes for all logged-in users including domain administrators.",
        "Harvest all domain credentials for unrestricted lateral movement.",
        "Full domain compromise — every account credential exposed to attacker.",
        ("ISOLATE host from network immediately — do not shut down", "Reset ALL domain admin and service account passwords NOW", "Enable Windows Credential Guard to prevent future LSASS reads"),
        0.01,
    ),
    Verdict(
        ("185.220", "beacon", "cobalt", "meterpreter", "reverse shell", " c2"),
        "C2 Beacon (T1071.001)",
        "Host communicating with known command-and-control infrastructure. Confirms active malware infection with remote operator having interactive shell access.",
        "Maintain persistent remote access for data exfiltration and lateral movement.",
        "Active breach — attacker currently has hands-on access to this machine.",
        ("ISOLATE host from all networks immediately", "Capture memory image before powering off", "Hunt same C2 IOC across all other hosts"),
        0.01,
    ),
    Verdict(
        ("1102", "audit log cleared", "wevtutil", "event log"),
        "Audit Log Cleared (T1562.001)",
        "Windows audit log deliberately cleared — attacker destroying forensic evidence of their activity on this system.",
        "Cover tracks and prevent incident timeline reconstruction by defenders.",
        "Loss of all forensic evidence — full incident scope may be permanently unrecoverable.",
        ("Treat as fully compromised — initiate incident response NOW", "Check SIEM for log copies forwarded before clearing", "Forensically image disk before any remediation"),
        0.02,
    ),
    Verdict(
        ("4698", "scheduled task", "schtasks"),
        "Persistence via Scheduled Task (T1053.005)",
        "New scheduled task created — attackers use this to survive reboots and maintain persistent access even after malware removal.",
        "Establish long-term persistence so malware reinstalls itself after removal.",
        "Persistent foothold that survives system restarts and antivirus scans.",
        ("Review new task name and its target command", "Scan task binary with EDR/VirusTotal", "Audit all recently created scheduled tasks across endpoints"),
        0.15,
    ),
    Verdict(
        (),
        "High-Confidence Anomaly",
        "Event scored {score}/1.0 — 2 or more independent ML models flagged this as significantly outside the normal behavioral baseline.",
        "Unknown — statistical anomaly requires manual analyst investigation.",
        "High — abnormal behaviour with no matching signature needs immediate review.",
        ("Review complete activity history of {ip} today", "Cross-reference with external threat intel (VirusTotal, Shodan)", "Check all correlated events in same 5-minute window"),
        0.20,
    ),
    Verdict(
        (),
        "Low-Risk Event",
        "Anomaly score {score}/1.0 is within the normal baseline. No known attack signatures detected in the message content.",
        "None identified.",
        "Low — consistent with normal activity. No action required.",
        ("Continue monitoring for pattern changes", "No immediate action required"),
        0.80,
    ),
)

# Cascade v2, shorter texts and no scheduled-task branch.
CASCADE_V2 = (
    Verdict(
        ("sql", "inject", "union select", "1=1", "xp_cmdshell"),
        "SQL Injection (T1190)",
        "Attacker from {ip} injecting SQL code into web inputs to bypass authentication or dump database. Confirms automated attack tool.",
        "Steal credentials, dump database contents, or gain admin access.",
        "Full database compromise — all user data exposed.",
        ("Block {ip} at WAF immediately", "Audit all DB queries in last 24h", "Check for successful login bypasses"),
        0.03,
    ),
    Verdict(
        ("failed password", "invalid user", "authentication failure", "4625"),
        "Brute Force (T1110.001)",
        "Automated credential attack from {ip} cycling through username/password combinations at machine speed.",
        "Find valid credentials for initial access.",
        "Account compromise and lateral movement if successful.",
        ("Block IP {ip} immediately", "Enable account lockout (5 attempts)", "Enforce MFA on all external services"),
        0.02,
    ),
    Verdict(
        ("powershell", "-enc", "encodedcommand", "invoke-expression"),
        "Encoded PowerShell (T1059.001)",
        "Base64-encoded PowerShell executed — common AV/EDR evasion technique hiding malicious payload.",
        "Execute malware or reverse shell while evading detection.",
        "Malware installation or backdoor deployment.",
        ("Decode and analyse the Base64 payload", "Isolate affected host", "Enable Script Block Logging via Group Policy"),
        0.07,
    ),
    Verdict(
        ("lsass", "credential dump", "mimikatz", "procdump"),
        "LSASS Credential Dump (T1055.012)",
        "LSASS memory being read — extracts all plaintext passwords and NTLM hashes from the Windows credential store.",
        "Harvest domain credentials for unrestricted lateral movement.",
        "Full domain compromise — every account exposed.",
        ("ISOLATE host immediately", "Reset ALL domain admin passwords", "Enable Windows Credential Guard"),
        0.01,
    ),
    Verdict(
        ("185.220", "beacon", "cobalt", "meterpreter", "reverse shell", "c2"),
        "C2 Beacon (T1071.001)",
        "Active malware communicating with command-and-control server — attacker has interactive shell access.",
        "Maintain persistent remote access for exfiltration and lateral movement.",
        "Active breach — attacker currently controls this machine.",
        ("ISOLATE host from network NOW", "Capture memory image for forensics", "Hunt same C2 IOC across all hosts"),
        0.01,
    ),
    Verdict(
        ("1102", "audit log cleared", "wevtutil"),
        "Log Clearing (T1562.001)",
        "Windows audit log deliberately cleared — attacker destroying forensic evidence of their activity.",
        "Cover tracks and prevent incident timeline reconstruction.",
        "Loss of all forensic evidence on this system.",
        ("Treat as fully compromised — start IR", "Check SIEM for log copies", "Forensically image disk before cleanup"),
        0.02,
    ),
    Verdict(
        (),
        "High Anomaly",
        "Score {score}/1.0 — 2+ ML models flagged this as significantly outside normal baseline.",
        "Unknown — statistical anomaly requires manual review.",
        "High — abnormal behaviour needs analyst investigation.",
        ("Review full activity history of {ip}", "Cross-reference with threat intel", "Check correlated events in same window"),
        0.20,
    ),
    Verdict(
        (),
        "Low Risk",
        "Score {score}/1.0 within normal baseline. No attack signatures detected.",
        "None identified.",
        "Low.",
        ("Continue monitoring", "No action needed"),
        0.80,
    ),
)

# Worked example placed in front of the v1 prompt.
EXAMPLE_V1 = """
Example of a perfect response:

Event: Failed password for invalid user admin from 91.108.4.55 port 22
Severity: HIGH | MITRE: T1110.001

{
  "threat_type": "SSH Brute Force Attack",
  "explanation": "Automated credential stuffing from 91.108.4.55 cycling common passwords at machine speed. Confirms scripted tool like Hydra or Medusa targeting SSH on port 22.",
  "attacker_intent": "Gain initial SSH access by guessing valid credentials for persistent shell access.",
  "risk": "Successful login gives attacker shell — lateral movement, data theft, or ransomware follows.",
  "recommendations": [
    "Block IP 91.108.4.55 at perimeter firewall immediately",
    "Disable SSH password auth — enforce key-based authentication only",
    "Enable fail2ban: 15-minute lockout after 5 failed attempts"
  ],
  "false_positive_probability": 0.01
}

Now analyze the following event with the same quality:
"""

# Worked examples placed in front of the few-shot prompt.
EXAMPLES_V2 = """
Here are 2 examples of perfect analysis:

EXAMPLE 1:
Event: "Failed password for invalid user admin from 91.108.4.55 port 44392 ssh2"
Severity: HIGH | MITRE: T1110.001 | Score: 0.82
Response:
{
  "threat_type": "SSH Brute Force Attack",
  "explanation": "Automated credential stuffing from 91.108.4.55 cycling through common usernames at machine speed — 847 attempts in 4 minutes confirms a scripted tool like Hydra or Medusa. The attacker is targeting the SSH service on port 22 with a dictionary of common passwords.",
  "attacker_intent": "Gain initial access by discovering valid SSH credentials to establish an interactive shell on the target system.",
  "risk": "If a valid credential is found, attacker gains persistent shell access and can begin lateral movement, data theft, or ransomware deployment.",
  "recommendations": [
    "Block IP 91.108.4.55 at the perimeter firewall immediately and add to threat intel blocklist",
    "Disable password authentication for SSH — enforce key-based authentication only",
    "Move SSH to a non-standard port and implement fail2ban with a 15-minute lockout"
  ],
  "false_positive_probability": 0.01
}

EXAMPLE 2:
Event: "LSASS memory read detected - possible credential dump"
Severity: CRITICAL | MITRE: T1055.012 | Score: 0.96
Response:
{
  "threat_type": "LSASS Credential Dump",
  "explanation": "The Local Security Authority Subsystem Service (LSASS) process memory is being read by an unauthorised process — this is the primary Windows credential store containing plaintext passwords and NTLM hashes for all logged-in users. This is a hands-on-keyboard attacker, not automated malware.",
  "attacker_intent": "Extract all domain credentials from memory to enable unrestricted lateral movement and privilege escalation across every system in the network.",
  "risk": "Full domain compromise — every account credential exposed. Attacker can impersonate domain admins, access all file shares, and persist indefinitely.",
  "recommendations": [
    "ISOLATE this host from the network immediately — do not shut down, take a memory image first",
    "Reset ALL domain admin and service account passwords before the host is reconnected",
    "Enable Windows Credential Guard via Group Policy to prevent future LSASS reads"
  ],
  "false_positive_probability": 0.01
}

Now analyze the following event with the same quality and format:
"""

# Opening and closing texts of the prompts.
ROLE_LINE = "You are a senior SOC analyst with 10 years of incident response experience.\n"
CHAIN_OPENING = """You are a senior SOC analyst. Think through this step by step before answering.

Step 1: What attack technique is this?
Step 2: What is the attacker trying to do?
Step 3: What is the worst-case outcome?
Step 4: What should the analyst do RIGHT NOW?

Then provide your final answer as JSON only:
"""
FAST_OPENING = "SOC analyst. Analyze this security event. JSON only, no other text.\n"
ANSWER_FORMAT_V1 = """Respond ONLY with raw JSON — no markdown, no code blocks, no extra text:
{
  "threat_type": "specific threat name",
  "explanation": "2-3 sentences explaining what is happening technically",
  "attacker_intent": "what the attacker wants to achieve",
  "risk": "specific consequence if not stopped",
  "recommendations": ["specific action 1", "specific action 2", "specific action 3"],
  "false_positive_probability": 0.05
}"""
ANSWER_FORMAT_V2 = """
Respond ONLY with this JSON — no markdown, no explanation, just raw JSON:
{
  "threat_type": "short threat name",
  "explanation": "2-3 sentences: what is happening, how it works technically",
  "attacker_intent": "what the attacker wants to achieve with this technique",
  "risk": "specific consequence if not stopped",
  "recommendations": ["specific action 1", "specific action 2", "specific action 3"],
  "false_positive_probability": 0.05
}"""

# Urgency line by severity.
URGENCY_V1 = {
    "CRITICAL": "\n⚠️ CRITICAL SEVERITY — possible active breach. Be urgent.\n",
}
URGENCY_V2 = {
    "CRITICAL": "\n⚠️  CRITICAL SEVERITY — This may be an active breach. Be direct and urgent.\n",
    "HIGH": "\n🔴 HIGH SEVERITY — Immediate analyst action required.\n",
}

# Row used when an answer is not valid JSON, by profile.
TEXT_FALLBACK = {
    "v1": {
        "explanation_length": 250,
        "attacker_intent": "See explanation above",
        "recommendation": "Investigate this event immediately",
    },
    "v2": {
        "explanation_length": 300,
        "attacker_intent": "See explanation",
        "recommendation": "Investigate immediately",
    },
}
FALLBACK_THREAT = "AI Analysis"
FALLBACK_RISK = "Review manually"
FALLBACK_PROBABILITY = 0.1

# Rubric points and grade limits.
RUBRIC_FIELDS = (
    "threat_type", "explanation", "attacker_intent", "risk",
    "recommendations", "false_positive_probability",
)
GRADES = (("A", 90), ("B", 75), ("C", 60))
