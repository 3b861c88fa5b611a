"""Fixed values of the log formats: patterns, word lists and severity lookups."""

# Severity levels, most severe first, with their numeric rank.
SEVERITY_RANK = {
    "CRITICAL": 4,
    "HIGH": 3,
    "MEDIUM": 2,
    "LOW": 1,
    "INFO": 0,
}

# Numeric code of every line format.
FORMAT_CODE = {
    "syslog": 0,
    "apache": 1,
    "windows_event": 2,
    "json": 3,
    "unknown": 4,
}

# Line patterns. Groups are positional.
# (?U) keeps \w, \d, \s and \b Unicode-aware and (?d) makes only "\n" end a line.
SYSLOG_LINE = r"^(?dU)(\w{3})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.+)"
SYSLOG_LINE_LENIENT = r"^(?dU)(\w{3})\s+(\d+)\s+(\d{1,2}:\d{2}:\d{2})\s+(\S+)\s+(\S+):\s+(.+)"
ACCESS_LINE = (
    r"^(?dU)(\d+\.\d+\.\d+\.\d+)\s+-\s+-\s+\[([^\]]+)\]\s+"
    r'"(\w+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+|-)'
)
WINDOWS_LINE = (
    r"^(?dU)(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"EventID=(\d+)\s+"
    r"(?:User=(\S+)\s+)?"
    r"(?:Source=(\d+\.\d+\.\d+\.\d+)\s+)?"
    r"Message=(.+)"
)
DOTTED_QUAD = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"

# Syslog words per severity, tried from the most severe down.
SYSLOG_WORDS = {
    "CRITICAL": ["exploit", "rootkit", "ransomware", "intrusion detected", "critical"],
    "HIGH": [
        "authentication failure", "failed password", "invalid user",
        "refused connect", "port scan", "brute force", "sudo",
    ],
    "MEDIUM": ["warning", "error", "denied", "rejected", "timeout"],
    "LOW": ["notice", "info", "started", "stopped", "restarted"],
}

# Severity by Windows event id in the one-line text format (others: LOW).
WINDOWS_SEVERITY = {
    "4625": "HIGH",
    "4648": "HIGH",
    "4720": "HIGH",
    "4728": "HIGH",
    "4732": "MEDIUM",
    "4756": "MEDIUM",
    "4688": "MEDIUM",
    "4698": "HIGH",
    "4702": "MEDIUM",
    "4769": "MEDIUM",
    "4776": "MEDIUM",
    "7045": "HIGH",
    "1102": "CRITICAL",
    "4657": "MEDIUM",
    "5156": "LOW",
    "5158": "LOW",
}

# JSON key aliases, first truthy one wins.
JSON_TIMESTAMP_KEYS = ["timestamp", "time", "@timestamp", "ts"]
JSON_SEVERITY_KEYS = ["severity", "level", "log_level"]
JSON_IP_KEYS = ["source_ip", "src_ip", "client_ip", "remote_addr"]
JSON_MESSAGE_KEYS = ["message", "msg", "description"]

# Alternative spellings of JSON severities.
SEVERITY_SPELLINGS = {
    "MEDIUM": ["WARNING", "WARN"],
    "HIGH": ["ERROR", "ERR"],
    "LOW": ["DEBUG", "TRACE"],
}

# Severity by event id in multi-line exports, profile A (others: INFO).
EXPORT_SEVERITY_A = {
    "4624": "LOW",
    "4625": "HIGH",
    "4634": "LOW",
    "4648": "HIGH",
    "4656": "MEDIUM",
    "4663": "MEDIUM",
    "4688": "MEDIUM",
    "4698": "HIGH",
    "4700": "HIGH",
    "4702": "MEDIUM",
    "4720": "HIGH",
    "4722": "MEDIUM",
    "4725": "MEDIUM",
    "4728": "HIGH",
    "4732": "MEDIUM",
    "4756": "HIGH",
    "4769": "MEDIUM",
    "4776": "MEDIUM",
    "4798": "MEDIUM",
    "4799": "MEDIUM",
    "7034": "HIGH",
    "7036": "LOW",
    "7045": "HIGH",
    "1102": "CRITICAL",
}

# Profile B knows eight more event ids.
EXPORT_SEVERITY_B = {
    **EXPORT_SEVERITY_A,
    "1100": "HIGH",
    "4647": "LOW",
    "4672": "MEDIUM",
    "4689": "LOW",
    "4724": "MEDIUM",
    "4726": "HIGH",
    "4740": "HIGH",
    "4767": "MEDIUM",
}

# Profile B message text by event id.
EXPORT_TEXT_B = {
    "4624": "Successful logon",
    "4625": "Failed logon attempt",
    "4634": "User logoff",
    "4648": "Logon with explicit credentials",
    "4672": "Special privileges assigned",
    "4688": "New process created",
    "4698": "Scheduled task created",
    "4720": "New user account created",
    "4726": "User account deleted",
    "4728": "Member added to security group",
    "4740": "User account locked out",
    "4769": "Kerberos service ticket requested",
    "4776": "NTLM credential validation",
    "7034": "Service crashed unexpectedly",
    "7045": "New service installed",
    "1102": "Security audit log cleared",
}

# Address prefixes that count as internal.
PRIVATE_ADDRESS = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.0\.0\.0)"

# Case-insensitive content patterns of the feature job.
SQL_WORDS = r"union\s+select|insert\s+into|drop\s+table|1=1|or\s+1|sql\s+inject|xp_cmdshell"
EXEC_WORDS = (
    r"cmd\.exe|powershell|/bin/sh|/bin/bash|exec\(|eval\(|base64|-enc|-encodedcommand|wget |curl "
)
C2_WORDS = r"c2|beacon|185\.220\.|91\.108\.|exfil|reverse.?shell|meterpreter|cobalt.?strike"
AUTH_WORDS = (
    r"fail|invalid user|authentication failure|bad password|wrong password|unauthorized|4625"
)
PRIVILEGE_WORDS = r"sudo|privilege|escalat|admin|root|4728|4732|domain admin|runas"
