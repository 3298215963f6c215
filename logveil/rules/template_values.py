"""Analysis templates with their ATT&CK fields, and the signals that score them."""

# Fixed values: (id, name, category, tactic, tactic id, technique, technique id).
TEMPLATES = [
    ("brute_force", "Brute force / password spraying", "Credential Access", "Credential Access", "TA0006", "Brute Force", "T1110"),
    ("valid_account_login", "Suspicious successful logon / valid accounts", "Initial Access", "Defense Evasion", "TA0005", "Valid Accounts", "T1078"),
    ("lateral_movement", "Lateral movement (RDP/SMB/WinRM/PsExec)", "Lateral Movement", "Lateral Movement", "TA0008", "Remote Services", "T1021"),
    ("privilege_escalation", "Privilege escalation", "Privilege Escalation", "Privilege Escalation", "TA0004", "Abuse Elevation Control Mechanism", "T1548"),
    ("persistence", "Persistence (services, tasks, run keys, accounts)", "Persistence", "Persistence", "TA0003", "Scheduled Task/Job", "T1053"),
    ("execution_scripting", "Suspicious execution (PowerShell / scripting / LOLBins)", "Execution", "Execution", "TA0002", "Command and Scripting Interpreter", "T1059"),
    ("defense_evasion", "Defense evasion / log tampering", "Defense Evasion", "Defense Evasion", "TA0005", "Indicator Removal", "T1070"),
    ("discovery", "Discovery / reconnaissance", "Discovery", "Discovery", "TA0007", "Account Discovery", "T1087"),
    ("c2_beaconing", "Command & control / beaconing", "Command and Control", "Command and Control", "TA0011", "Application Layer Protocol", "T1071"),
    ("dns_tunneling", "DNS tunneling / DNS exfiltration", "Command and Control", "Command and Control", "TA0011", "DNS", "T1071.004"),
    ("exfiltration", "Data exfiltration", "Exfiltration", "Exfiltration", "TA0010", "Exfiltration Over Alternative Protocol", "T1048"),
    ("ransomware_impact", "Ransomware / destructive impact", "Impact", "Impact", "TA0040", "Data Encrypted for Impact", "T1486"),
    ("account_manipulation", "Account creation / manipulation", "Persistence", "Persistence", "TA0003", "Account Manipulation", "T1098"),
    ("web_attack", "Web application attack (injection / exploit)", "Initial Access", "Initial Access", "TA0001", "Exploit Public-Facing Application", "T1190"),
    ("phishing", "Phishing / suspicious email", "Initial Access", "Initial Access", "TA0001", "Phishing", "T1566"),
]

# Template id -> (weight, pattern), case-insensitive, in order.
SIGNALS = {
    "brute_force": [
        (3, r"failed password|authentication fail|auth failure|login failed"),
        (3, r"\b4625\b|\b4771\b"),
        (2, r"invalid user|unknown user|bad password"),
        (2, r"accepted password.*after|success.*after .*fail"),
        (2, r"account lock|lockout|locked out"),
        (1, r"sshd|ssh2"),
    ],
    "valid_account_login": [
        (3, r"\b4624\b"),
        (2, r"accepted password|accepted publickey|logon success"),
        (2, r"logon type|interactive|remoteinteractive"),
        (2, r"new sign-in|unfamiliar location|impossible travel"),
    ],
    "lateral_movement": [
        (3, r"psexec|paexec|\bwinrm\b|wmiexec|smbexec"),
        (3, r"\b4648\b|\b4624\b.*type\s*[:=]?\s*3|logon type\s*[:=]?\s*10"),
        (2, r"\brdp\b|terminal services|mstsc|3389"),
        (2, r"admin\$|ipc\$|c\$|\\\\[\w.-]+\\[a-z]+\$"),
        (2, r"\b7045\b|service control manager|new service"),
        (1, r"\b445\b|\b5985\b|\b5986\b"),
    ],
    "privilege_escalation": [
        (3, r"\b4672\b|special privileges|sedebugprivilege|setakeowner"),
        (3, r"\b4728\b|\b4732\b|\b4756\b|added to.*(admin|domain admins)"),
        (2, r"\bsudo\b|su\[|to root|uid=0|runas|elevation"),
        (2, r"uac|bypassuac|consent\.exe|fodhelper|token manipulation"),
    ],
    "persistence": [
        (3, r"schtasks|scheduled task|\b4698\b|cron(tab)?|at\.exe"),
        (3, r"\b7045\b|new service|service creation|systemctl enable"),
        (2, r"run(once)?\\|currentversion\\run|registry.*\\run\b"),
        (2, r"\b4720\b|user account.*created|adduser|useradd|net user .*\/add"),
        (2, r"wmi.*subscription|eventconsumer|startup folder"),
    ],
    "execution_scripting": [
        (3, r"powershell.*(-enc|-e |frombase64|-nop|-w hidden|iex|invoke-expression)"),
        (3, r"mshta|rundll32|regsvr32|certutil|bitsadmin|wmic\b"),
        (2, r"cmd\.exe\s*/c|/k\s|wscript|cscript|\bbash -c\b|curl .*\|\s*sh"),
        (2, r"\b4688\b|process create|sysmon.*event id.*1|new process"),
        (2, r"downloadstring|downloadfile|invoke-webrequest|new-object net\.webclient"),
    ],
    "defense_evasion": [
        (3, r"\b1102\b|\b104\b|event log (was )?cleared|wevtutil cl|clear-eventlog"),
        (3, r"vssadmin.*delete|shadowcopy.*delete|wbadmin delete|bcdedit"),
        (2, r"defender.*(disabl|off)|set-mppreference|stop.*(av|edr|sense)"),
        (2, r"auditpol.*(disable|clear)|timestomp|attrib \+h"),
    ],
    "discovery": [
        (3, r"bloodhound|sharphound|adfind|nltest|dsquery"),
        (2, r"\bwhoami\b|net (user|group|view|localgroup)|net1 \b"),
        (2, r"\bnmap\b|masscan|arp -a|ipconfig /all|systeminfo|nslookup"),
        (2, r"ldapsearch|get-aduser|get-adcomputer|enum"),
    ],
    "c2_beaconing": [
        (3, r"cobalt\s*strike|beacon|sliver|meterpreter|empire|covenant"),
        (2, r"user-agent.*(curl|python|powershell|go-http|wget)"),
        (2, r"beacon(ing)?|jitter|callback|c2\b|command and control"),
        (2, r"\.onion|dyndns|no-ip|duckdns|ngrok|pastebin\.com/raw"),
        (1, r"GET /[a-z0-9]{6,}\s|POST /[a-z0-9]{6,}\s"),
    ],
    "dns_tunneling": [
        (3, r"\bdns\b.*\b(txt|null)\b|query: .*\b(txt|null)\b"),
        (2, r"named|bind|dnsmasq|query:|resolver"),
        (2, r"[a-z0-9]{30,}\.[a-z0-9-]+\.[a-z]{2,}"),
        (2, r"dns ?tunnel|iodine|dnscat"),
    ],
    "exfiltration": [
        (3, r"bytes_out|bytes sent|out=\d{6,}|sc-bytes \d{6,}|\d{7,}\s*bytes"),
        (2, r"mega\.nz|dropbox|wetransfer|pastebin|anonfiles|transfer\.sh|drive\.google"),
        (2, r"\.(zip|rar|7z|tar\.gz|tgz)\b|rar a |7z a |compress-archive"),
        (2, r"\bftp\b|sftp|scp |put \S+|curl -T|upload"),
    ],
    "ransomware_impact": [
        (3, r"ransom|\.lock(ed|y|bit)|\.crypt|readme.*decrypt|how_to_decrypt|\.onion"),
        (3, r"vssadmin.*delete shadows|wmic shadowcopy delete|wbadmin delete catalog"),
        (2, r"mass (rename|encrypt)|bcdedit.*recoveryenabled no|cipher /w"),
        (2, r"lockbit|conti|blackcat|alphv|ryuk|revil|akira"),
    ],
    "account_manipulation": [
        (3, r"\b4720\b|\b4722\b|\b4724\b|\b4738\b|user account.*(created|enabled|changed)"),
        (2, r"useradd|adduser|net user .*\/add|new-aduser|passwd "),
        (2, r"access key created|createaccesskey|add.*credential|service principal"),
        (2, r"password reset|set password|reset-password"),
    ],
    "web_attack": [
        (3, r"union\s+select|or\s+1=1|' or '|sleep\(\d|benchmark\(|information_schema"),
        (3, r"\.\./\.\./|%2e%2e%2f|/etc/passwd|c:\\windows\\win\.ini"),
        (2, r"<script>|onerror=|javascript:|alert\(|%3cscript"),
        (2, r"\b(GET|POST)\b.*\b(40[0-9]|500)\b|waf|mod_security|owasp"),
        (1, r"sqlmap|nikto|acunetix|burp"),
    ],
    "phishing": [
        (3, r"spf=fail|dkim=fail|dmarc=fail|dmarc.*(quarantine|reject)"),
        (2, r"phish|spam|quarantine|spamscore|spam score|reputation"),
        (2, r"postfix|sendmail|exim|message-id|from=<|rcpt to"),
        (2, r"attachment|\.(html|htm|docm|xlsm|iso|img|lnk) (attach|file)"),
    ],
}
