"""Patterns, word lists and tables on which results depend character by character."""

# Fixed values: (id, source, label, category, pattern), in claim order; the last group that took part is the value.
RULES = [
    ("windows-sid", "Windows Event Log", "SID", "identities", r"\bS-1-\d+(?:-\d+){3,}\b"),
    ("azure-resource-id", "Microsoft Azure", "RESOURCE", "network", r'(?i)\"resource[_-]?id\"\s*:\s*\"([^\"]+)\"'),
    ("aws-arn", "AWS (CloudTrail, Config, S3, Security Hub)", "ARN", "network", r"""(?i)\barn:aws[a-z\-]*:[a-z0-9\-]*:[a-z0-9\-]*:\d{12}:[^\s\"',\\]+"""),
    ("cloud-resource-name", "AWS Config & GCP audit", "RESOURCE", "network", r'(?i)\"resource[_-]?name\"\s*:\s*\"([^\"]+)\"'),
    ("credit-card", "Generic secrets", "CC", "secrets", r"\b(?:\d[ -]?){13,16}\b"),
    ("api-keys", "Generic secrets", "APIKEY", "secrets", r"\b(?:sk-[A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z\-_]{30,})\b"),
    ("aws-principal-id", "AWS (CloudTrail, Security Hub)", "KEYID", "secrets", r"\bA(?:IDA|ROA|GPA|IPA|NPA|NVA|SIA|BIA|CCA)[A-Z0-9]{16,}\b"),
    ("saas-object-id", "Okta & Duo Security", "KEYID", "secrets", r"\b(?:(?:00[ugo]|0oa)[A-Za-z0-9]{15,}|D[UIAG][A-Z0-9]{18})\b"),
    ("saas-object-id-kv", "Atlassian Jira & JumpCloud", "KEYID", "secrets", r'(?i)\"[a-z_]*id\"\s*:\s*\"([0-9a-z]{24})\"'),
    ("cloud-account-id", "AWS, Dynamics 365, OneLogin", "ACCTID", "secrets", r'(?i)\b[a-z_]*(?:account|tenant|customer|subscriber|org(?:anization)?)[_-]?id\"?\s*[=:]\s*\"?(\d{4,20})\b'),
    ("saas-user-id-num", "OneLogin, Zoom, JumpCloud", "ACCTID", "secrets", r'(?i)\"[a-z_]*user[_-]?id\"\s*:\s*(\d{4,20})\b'),
    ("secret-kv", "Generic secrets", "SECRET", "secrets", r"""(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|auth|community|client[_-]?id)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]+)"""),
    ("ps-securestring", "PowerShell", "SECRET", "secrets", r"""(?i)ConvertTo-SecureString\s+(?:-(?:String|AsPlainText)\s+)*[\"']([^\"'\r\n]+)[\"']"""),
    ("ps-secret-param", "PowerShell", "SECRET", "secrets", r"""(?i)(?<![\w-])--?(?:password|passwd|pwd|accesstoken|api[_-]?key|token|secret|clientsecret|sharedkey|passphrase)[ \t]+[\"']?([^\s\"',;]+)"""),
    ("net-use-password", "Windows CLI", "SECRET", "secrets", r"""(?i)/user:\S+[ \t]+([^\s\"',;<]+)"""),
    ("az-login-secret", "Azure CLI", "SECRET", "secrets", r"""(?i)\baz[ \t]+login\b[^\r\n]*?[ \t]-p[ \t]+[\"']?([^\s\"']+)"""),
    ("bearer-token", "Generic secrets", "SECRET", "secrets", r"(?i)\bBearer[ \t]+([A-Za-z0-9._\-]{16,})"),
    ("serial-kv", "SonicWALL & devices", "SERIAL", "secrets", r"""(?i)\b(?:serial(?:[ _-]?(?:no|num|number))?|sn)=[\"']?([A-Za-z0-9\-]{6,})"""),
    ("watchguard-serial", "WatchGuard Fireware", "SERIAL", "secrets", r"(?m)^(?:<\d+>)?[A-Z][a-z]{2}[ \t]+\d{1,2}[ \t]\d{2}:\d{2}:\d{2}[ \t]+\S+[ \t]+([0-9A-F]{12,16})[ \t]+\("),
    ("uuid", "Generic secrets", "UUID", "secrets", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("hex-blob", "Generic secrets", "HASH", "secrets", r"\b[A-Fa-f0-9]{32,}\b"),
    ("email", "Generic", "EMAIL", "identities", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("sysmon-user", "Sysmon (Windows & Linux)", "USER", "identities", r"(?im)^[ \t]*(?:Parent|Source|Target|Original)?User[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("sysmon-user-xml", "Sysmon (Windows & Linux)", "USER", "identities", r"""(?i)<Data Name=[\"'](?:Parent|Source|Target|Original)?User[\"']>([^<]+)</Data>"""),
    ("sysmon-user-json", "Sysmon (Windows & Linux)", "USER", "identities", r'(?i)\"(?:Parent|Source|Target|Original)User\"\s*:\s*\"([^\"]+)\"'),
    ("sysmon-hostname", "Sysmon (Windows & Linux)", "HOST", "network", r"(?im)^[ \t]*(?:Source|Destination)Hostname[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("sysmon-dns-query", "Sysmon (Windows & Linux)", "HOST", "network", r"(?im)^[ \t]*QueryName[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("sysmon-hostname-xml", "Sysmon (Windows & Linux)", "HOST", "network", r"""(?i)<Data Name=[\"'](?:Source|Destination)Hostname[\"']>([^<]+)</Data>"""),
    ("sysmon-dns-query-xml", "Sysmon (Windows & Linux)", "HOST", "network", r"""(?i)<Data Name=[\"']QueryName[\"']>([^<]+)</Data>"""),
    ("sysmon-host-json", "Sysmon (Windows & Linux)", "HOST", "network", r'(?i)\"(?:(?:Source|Destination)Hostname|QueryName)\"\s*:\s*\"([^\"]+)\"'),
    ("saas-actor-kv", "SaaS audit logs (GitHub, Jira, Zoom, OneLogin)", "USER", "identities", r'(?i)\"(?:actor|author(?:[_-]?key)?|operator|initiator|principal|impersonator|requester|assignee|created[_-]?by|modified[_-]?by|updated[_-]?by|closed[_-]?by|deleted[_-]?by|performed[_-]?by|[a-z_]*user[_-]?name)\"\s*:\s*\"([^\"]+)\"'),
    ("saas-actor-object", "Duo Security, JumpCloud, Zoom", "USER", "identities", r'(?i)\"(?:user|actor|initiated[_-]?by|participant|operator|owner|assignee|author|member)\"\s*:\s*\{[^{}]*?\"(?:user[_-]?)?name\"\s*:\s*\"([^\"]+)\"'),
    ("group-name-kv", "CylancePROTECT, M365 Defender, Purview, Imperva", "GROUP", "identities", r"""(?i)\b(?:[a-z_]*group|zone|policy|role)[ _-]?names?[\"']?\s*[=:][ \t]*[(\"']?([^,;()\"'\r\n\t]{1,120}?)(?=[ ]{2,}|\t|\s*[,;)\"'\r\n]|$)"""),
    ("org-unit-kv", "Entra ID, Okta, Office 365", "GROUP", "identities", r'(?i)\"(?:department|division|team|business[_-]?unit|target[_-]?user[_-]?or[_-]?group[_-]?name)\"\s*:\s*\"([^\"]+)\"'),
    ("group-object", "Atlassian Jira audit", "GROUP", "identities", r'(?i)\"(?:object[_-]?item|group|team|role)\"\s*:\s*\{[^{}]*?\"name\"\s*:\s*\"([^\"]+)\"'),
    ("cef-custom-label", "Imperva WAF Gateway & CEF", "GROUP", "identities", r"""(?i)\bcs(\d)Label=(?:policy|rule|group|department|tenant|site|application|app)\b.{0,120}?\bcs\1=([^\s\"']+)"""),
    ("org-tenant-kv", "GitHub, Dynamics 365, Atlassian Jira", "ORG", "identities", r'(?i)\"(?:org|organi[sz]ation(?:[_-]?name)?|business(?:[_-]?name)?|tenant(?:[_-]?name)?|workspace|company(?:[_-]?name)?|customer(?:[_-]?name)?)\"\s*:\s*\"([^\"]+)\"'),
    ("subject-topic-kv", "Zoom & SaaS admin logs", "SUBJECT", "identities", r'(?i)\"(?:topic|meeting[_-]?topic|operation[_-]?detail|session[_-]?name)\"\s*:\s*\"([^\"]+)\"'),
    ("ad-dn", "Active Directory", "DN", "identities", r"""(?im)\b(?:CN|OU|DC)=[^,;\r\n]+?(?:\s*,\s*(?:CN|OU|DC)=[^,;\r\n]+?)+(?=[\s,;\"')\]]|$)"""),
    ("winxml-user", "Windows Event Log (XML)", "USER", "identities", r"""(?i)<Data Name=[\"'](?:TargetUserName|SubjectUserName|AccountName|SamAccountName|LogonAccount)[\"']>([^<]+)</Data>"""),
    ("winxml-domain", "Windows Event Log (XML)", "DOMAIN", "identities", r"""(?i)<Data Name=[\"'](?:TargetDomainName|SubjectDomainName|DomainName)[\"']>([^<]+)</Data>"""),
    ("winevent-user", "Windows Event Log", "USER", "identities", r"(?im)^[ \t]*(?:(?:New |Target |Subject |Caller )?(?:Account|User|Logon) Name|Logon Account|Target Account)[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("winevent-domain", "Windows Event Log", "DOMAIN", "identities", r"(?im)^[ \t]*(?:(?:Target |Subject |Caller )?(?:Account|Logon) Domain|Domain Name|Supplied Realm Name)[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("profile-path-user", "File paths (Windows)", "USER", "identities", r'(?i)\\+Users\\+([^\\/:*?\"<>|\s]+)'),
    ("home-path-user", "File paths (Linux/macOS)", "USER", "identities", r"(?<![\w/])/(?:home|Users)/([A-Za-z0-9._\-]{2,})"),
    ("user-kv", "Generic key=value / JSON / CEF / LEEF", "USER", "identities", r"""(?i)(?:user(?:[ _-]?name|[ _-]?id)?|usr[_-]?name|usr|login|account(?:[ _-]?name)?|uid|identity|target|sAMAccountName)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9._\\@\-]{2,})\b(?![ \t]*=)"""),
    ("domain-kv", "Generic key=value / JSON", "DOMAIN", "identities", r"""(?i)(?:account[ _-]?domain|domain[ _-]?name|logon[ _-]?domain)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9._\-]{2,})"""),
    ("ps-person-field", "PowerShell Format-List", "USER", "identities", r"(?im)^[ \t]*(?:DisplayName|GivenName|Surname|FullName|PrimaryOwnerName|Manager|EmployeeID|PrincipalName|Alias)[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("get-credential-user", "PowerShell", "USER", "identities", r"""(?i)Get-Credential[ \t]+(?:-UserName[ \t]+)?[\"']([^\"'\r\n]+)[\"']"""),
    ("graph-filter-user", "Microsoft Graph & Exchange", "USER", "identities", r"""(?i)\b(?:displayName|userPrincipalName|mail|givenName|surname|samAccountName|onPremisesSamAccountName|windowsLiveID)\s+-?eq\s+[\"']([^\"'\r\n]+)[\"']"""),
    ("user-at-ip", "QRadar SIM Audit & VMware", "USER", "identities", r"\b([A-Za-z][A-Za-z0-9._\-]{1,})@(?=(?:\d{1,3}\.){3}\d)"),
    ("epoxml-user", "McAfee ePO XML", "USER", "identities", r"(?i)<(?:UserName|User|AccountName|TargetUserName)>([^<]+)<"),
    ("epoxml-domain", "McAfee ePO XML", "DOMAIN", "identities", r"(?i)<(?:DomainName|Domain|NTDomain)>([^<]+)<"),
    ("displayname-json", "Azure & Entra ID", "USER", "identities", r'(?i)\"(?:user[_-]?)?display[_-]?name\"\s*:\s*\"([^\"]+)\"'),
    ("sshd-auth-user", "Linux sshd", "USER", "identities", r"(?i)\b(?:password|publickey|keyboard-interactive\S*) for (?:invalid user )?([A-Za-z0-9._\-]{2,}) from\b"),
    ("pam-session-user", "Linux su & pam", "USER", "identities", r"(?i)\bsession (?:opened|closed) for user ([A-Za-z0-9._\-]+)"),
    ("pam-by-user", "Linux su & pam", "USER", "identities", r"(?i)\bby ([A-Za-z0-9._\-]{2,})\(uid="),
    ("sudo-user", "Linux sudo", "USER", "identities", r"(?im)\bsudo(?:\[\d+\])?:[ \t]*([A-Za-z0-9._\-]+)[ \t]*:"),
    ("user-token", "Appliances (NetScaler, ESXi, ExtremeWare…)", "USER", "identities", r"(?i)\buser ([A-Za-z0-9._\\\-]{2,})(?=@| -| logged| from)"),
    ("netscaler-context", "Citrix NetScaler", "USER", "identities", r"(?i)\bContext ([A-Za-z0-9._\-]{2,})@"),
    ("access-log-authuser", "Apache & nginx access logs", "USER", "identities", r"(?m)^(?:\d{1,3}\.){3}\d{1,3} \S+ ([A-Za-z][A-Za-z0-9._\-]*) \["),
    ("squid-user", "Squid Web Proxy", "USER", "identities", r"(?m)^\d{9,10}\.\d{3}[ \t]+\d+[ \t]+(?:\d{1,3}\.){3}\d{1,3}[ \t]+[A-Z_]+/\d{3}[ \t]+\d+[ \t]+\w+[ \t]+\S+[ \t]+(\S+)[ \t]+\w+/"),
    ("qradar-offense-source", "QRadar offenses", "USER", "identities", r"""(?i)[\"']?offense[_\s-]?source[\"']?\s*[=:]\s*[\"']?([^\s\"',;]+)"""),
    ("quoted-user", "Cisco ASA & F5 BIG-IP", "USER", "identities", r"(?i)\buser(?:name)?\s+'([^'\r\n]{2,})'"),
    ("domain-backslash-user", "Windows DOMAIN\\user", "USER", "identities", r"(?<![\\/\-.])\b[A-Za-z0-9][A-Za-z0-9.\-]+\\+[A-Za-z0-9._\-]{2,}\b(?![\\/])(?!\ +(?:Users|Admins|Computers|Controllers|Operators|Guests)\b)"),
    ("phone", "Generic", "PHONE", "identities", r"(?<![\w.+-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}\b"),
    ("mac", "Generic network", "MAC", "network", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("ipv6", "Generic network", "IPV6", "network", r"(?<![:.\w])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{0,4}::(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})(?![:.\w])"),
    ("ipv4", "Generic network", "IP", "network", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("winevent-host", "Windows Event Log", "HOST", "network", r"(?im)^[ \t]*(?:Workstation(?: Name)?|Source Workstation|Caller Computer Name|Target Server Name|Computer)[ \t]*:[ \t]*([^\r\n]+?)[ \t]*$"),
    ("winxml-host", "Windows Event Log (XML)", "HOST", "network", r"""(?i)<Data Name=[\"'](?:Workstation(?:Name)?|MachineName)[\"']>([^<]+)</Data>"""),
    ("winxml-computer", "Windows Event Log (XML)", "HOST", "network", r"(?i)<Computer>([^<]+)</Computer>"),
    ("syslog-bsd-host", "Syslog header (BSD)", "HOST", "network", r"""(?m)(?:^|(?<=[\"']))(?:<\d+>)?[A-Z][a-z]{2}[ \t]+\d{1,2}[ \t]\d{2}:\d{2}:\d{2}[ \t]+([A-Za-z][A-Za-z0-9._\-]+)\b"""),
    ("cli-host-param", "CLI parameters (PowerShell…)", "HOST", "network", r"""(?i)-(?:computer(?:name)?|server|hostname|node|machine)\s+[\"']?([A-Za-z0-9][A-Za-z0-9._\-]+)"""),
    ("cloud-asset-kv", "GitHub, GCP, AWS, Power Platform, Okta, Office 365", "ASSET", "network", r'(?i)\"(?:repo(?:sitory)?(?:[_-]?name)?|project(?:[_-]?(?:id|name|number))?|environment(?:[_-]?name)?|namespace|bucket(?:[_-]?name)?|[a-z_]*app(?:lication)?[_-]?name|service[_-]?name|instance[_-]?name|site[_-]?name|alternate[_-]?id|source[_-]?file[_-]?name|destination[_-]?file[_-]?name|source[_-]?relative[_-]?url)\"\s*:\s*\"([^\"]+)\"'),
    ("cef-service-name", "Imperva WAF Gateway & CEF", "ASSET", "network", r"""(?i)\b(?:source|destination|dest)?service[_-]?name=([^\s\"']+)"""),
    ("s3-access-bucket", "AWS S3 server access logs", "ASSET", "network", r"(?m)^[0-9a-f]{64}[ \t]+([^\s\[]+)[ \t]+\["),
    ("s3-access-key", "AWS S3 server access logs", "ASSET", "network", r"\bREST\.[A-Z]+\.[A-Z]+[ \t]+(\S+)"),
    ("azure-blob-path", "Azure Storage", "ASSET", "network", r"""(?i)\.(?:blob|file|queue|table|dfs)\.core\.windows\.net(/[^\s\"'?<>]+)"""),
    ("s3-url-path", "AWS S3", "ASSET", "network", r"""(?i)s3[.\-][a-z0-9\-]*\.?amazonaws\.com(/[^\s\"'?<>]+)"""),
    ("sharepoint-path", "Office 365 & Purview", "ASSET", "network", r"""(?i)\.sharepoint\.com(/[^\"'\r\n]*?)(?=[\"'\r\n]|$)"""),
    ("host-kv", "Generic key=value / JSON / CEF", "HOST", "network", r"""(?i)(?:[a-z_]*host(?:[ _-]?name)?|\b(?:computer|server|node|machine)(?:[ _-]?name)?|dev(?:name|id)|device[ _-]?(?:name|id))[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9][A-Za-z0-9._\-]+)"""),
    ("epoxml-host", "McAfee ePO XML", "HOST", "network", r"(?i)<(?:MachineName|ComputerName|HostName)>([^<]+)<"),
    ("qualys-xml-host", "Qualys VM", "HOST", "network", r"(?i)<(?:NETBIOS|DNS|DNS_DATA|FQDN)>([^<]+)<"),
    ("host-in-prose", "Generic network", "HOST", "network", r"(?:(?i:host|hostname|computer|machine|workstation|server|device))[ \t]+([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+(?:\.[A-Za-z0-9][A-Za-z0-9\-]*)*)\b"),
    ("ps-transcript-name", "PowerShell", "HOST", "network", r"(?i)PowerShell_transcript[._]([A-Za-z0-9][A-Za-z0-9\-]+)"),
    ("dhcpd-host", "Linux DHCP", "HOST", "network", r"\(([A-Za-z][\w.\-]*)\) via\b"),
    ("unc-host", "UNC paths", "HOST", "network", r"""(?:(?<=::)|(?<![:\w]))\\{2,4}([A-Za-z0-9][A-Za-z0-9._\-]+)(?=\\|[\s\"',;)\]]|$)"""),
    ("compromised-entity", "Microsoft Defender for Cloud", "HOST", "network", r'(?i)\"compromised[_-]?entity\"\s*:\s*\"([^\"]+)\"'),
    ("wazuh-agent-json", "Wazuh", "HOST", "network", r'(?i)\"(?:agent|manager|cluster|node)\"\s*:\s*\{[^{}]*?\"name\"\s*:\s*\"([^\"]+)\"'),
    ("agent-name-kv", "Wazuh & agent logs", "HOST", "network", r"""(?i)(?<![\w-])agent(?:[ _-]?name)?[\"']?\s*[=:]\s*[\"']([^\"'\r\n]+)[\"']"""),
    ("wazuh-alert-host", "Wazuh", "HOST", "network", r"\(([A-Za-z][\w.\-]*)\)[ \t]+(?=(?:\d{1,3}\.){3}\d{1,3}->)"),
    ("syslog-iso-host", "Syslog header (ISO) & VMware", "HOST", "network", r"(?m)^(?:<\d+>\d?[ \t]+)?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?[ \t]+([A-Za-z][\w.\-]+)\b"),
    ("meraki-host", "Cisco Meraki", "HOST", "network", r"(?m)^\d{10}(?:\.\d+)?[ \t]+([A-Za-z][\w.\-]+)\b"),
    ("path-domain", "File paths", "HOST", "network", r"(?<=/)(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+(?:com|net|org|io|co|uk|de|fr|nl|eu|us|ca|au|jp|cn|ru|ch|se|no|dk|fi|it|es|pl|be|at|ie|nz|za|br|in|info|biz|gov|edu|mil|int|local|lan|loc|internal|corp|intra|intranet|ad|home|priv|private|localdomain)\b"),
    ("fqdn", "Generic network", "HOST", "network", r"(?:(?<=//)|(?<![/\\.\-]))\b(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}\b"),
]

# Spans that are kept as they are (the first group, if there is one).
KEEP_PATTERNS = [
    r"""(?i)\b(?:sha1|sha256|sha512|md5|imphash|authentihash|file[_-]?hash|sha256ac)\b[\"']?\s*[=:]\s*[\"']?([A-Fa-f0-9]{32,128})\b""",
    r"""(?i)\b(?:detector|alert|provider[_-]?alert|incident|rule|signature|policy|alert[_-]?policy|correlation|request|activity|operation)[_-]?id\b[\"']?\s*[=:]\s*[\"']?([0-9a-fA-F\-]{8,64})""",
    r"\b(T\d{4}(?:\.\d{3})?|TA\d{4})\b",
    r'(?i)\"(?:event[_-]?type|event[_-]?name|event[_-]?source|action|operation(?:[_-]?name)?|method[_-]?name|service[_-]?name|activity[_-]?type|category[_-]?type)\"\s*:\s*\"([a-z][a-z0-9_]*(?:\.[a-z0-9_]+)+)\"',
    r"\[(?:System|Microsoft|Windows|Net|Automation|PSObject)\.[A-Za-z0-9_.\[\]]+\]",
    r"(?i)New-Object[ \t]+(?:-TypeName[ \t]+)?([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)",
    r"\$[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+",
    r"\b(?:Microsoft|System)\.[A-Za-z0-9_.]+(?:\\[A-Za-z0-9_]+)?(?=::)",
    r"""(?i)\bxmlns(?::\w+)?=[\"']([^\"'\r\n]+)[\"']""",
    r"""(?i)<Provider\b[^>]{0,200}?Guid=[\"']\{?([0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})\}?""",
    r"(?i)\broot\\{1,4}(?:cimv2|subscription|default|wmi|rsop|policy|directory|standardcimv2)(?:\\{1,4}[A-Za-z0-9_]+)*",
    r"(?i)\b(?:__[A-Za-z]\w+|(?:CommandLine|ActiveScript|LogFile|NTEventLog|SMTP)EventConsumer)(?:\.[A-Za-z]\w*)?",
]

# Word lists.
DOMAIN_ALLOWLIST = [
    "example.com", "localhost", "anthropic.com", "api.anthropic.com", "google.com", "microsoft.com", "github.com", "security.microsoft.com",
    "portal.azure.com", "graph.microsoft.com", "login.microsoftonline.com", "login.microsoft.com", "protection.office.com", "compliance.microsoft.com",
    "console.aws.amazon.com", "console.cloud.google.com", "attack.mitre.org", "virustotal.com", "www.virustotal.com",
]
NOT_TLDS = [
    "py", "js", "ts", "json", "log", "txt", "md", "html", "css", "exe", "dll", "so", "sh", "yml", "yaml", "csv", "xml", "png", "jpg",
    "gif", "conf", "cfg", "ini", "bak", "tmp", "gz", "zip", "tar", "jar", "war", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "pdf",
    "rtf", "msi", "bat", "ps1", "vbs", "lnk", "sys", "dat", "db", "mdb", "evtx", "pcap", "type", "kind", "value", "count", "severity",
    "timestamp", "verdict", "scope", "service", "socket", "target", "timer", "mount", "slice", "swap", "automount", "hourly", "daily",
    "weekly", "monthly", "rules", "list", "repo", "spec", "lock", "pid", "sock", "old", "orig", "rpmnew",
]
NOT_HOSTS = [
    "info", "warn", "warning", "error", "err", "debug", "notice", "trace", "fatal", "crit", "critical", "alert", "emerg", "panic", "audit",
    "verbose", "users", "windows", "system32", "programdata", "program files", "temp", "tcp", "udp", "ssl", "tls", "np", "lpc",
]
BUILTIN_VALUES = [
    "-", "n/a", "null", "system", "local service", "network service", "anonymous logon", "nt authority", "nt", "workgroup", "window manager",
    "font driver host", "dwm-1", "dwm-2", "umfd-0", "umfd-1", "administrator", "guest", "public", "default", "default user", "defaultuser0",
    "all users", "local system", "trustedinstaller", "root", "https", "http", "ftp", "unknown", "none", "true", "false", "domain users",
    "domain admins", "domain computers", "domain controllers", "enterprise admins", "schema admins", "authenticated users", "everyone",
    "administrators", "remote desktop users", "backup operators", "account operators", "server operators", "print operators", "power users",
    "daemon", "bin", "sys", "sync", "games", "man", "lp", "mail", "news", "uucp", "proxy", "www-data", "backup", "list", "irc", "gnats",
    "nobody", "nogroup", "systemd-network", "systemd-resolve", "systemd-timesync", "messagebus", "syslog", "sshd", "postfix", "chrony",
    "ntp", "dbus", "polkitd", "rpc", "rpcuser", "nfsnobody", "apache", "nginx", "mysql", "postgres", "redis", "tss", "sssd", "colord",
    "avahi", "cups", "tcpdump", "usbmux", "_apt", "snapd", "kernoops", "landscape", "pollinate", "sshd_t",
]
PATH_WORDS = [
    "files", "documents", "desktop", "downloads", "pictures", "videos", "music", "favorites", "appdata", "local", "locallow", "roaming",
    "temp", "tmp", "windows", "winnt", "system32", "syswow64", "programdata", "program", "inetpub", "wwwroot", "drivers", "config",
    "microsoft", "common", "shared", "bin", "lib", "usr", "var", "etc", "opt", "srv",
]
SAAS_APPS = [
    "box", "dropbox", "salesforce", "workday", "servicenow", "slack", "zoom", "github", "gitlab", "jira", "confluence", "atlassian",
    "okta", "onelogin", "duo", "docusign", "jumpcloud", "proofpoint", "qualys", "cribl", "office 365", "microsoft 365", "sharepoint",
    "sharepoint online", "onedrive", "onedrive for business", "exchange", "exchange online", "microsoft teams", "teams", "outlook",
    "gmail", "google drive", "google workspace", "aws", "amazon web services", "azure", "gcp", "google cloud", "dynamics 365", "power bi",
    "power apps", "power automate", "zendesk", "hubspot", "netsuite", "sap", "oracle", "tableau", "snowflake", "databricks",
]
BUILTIN_PREFIXES = [
    "authority", "service", "builtin",
]
CSV_EXCLUDE = [
    "count", "date", "time", "duration", "description", "notes", "reason", "type", "code", "magnitude", "severity", "credibility", "relevance",
    "status", "category",
]
CSV_USER = [
    "user", "offensesource", "assigned", "owner", "analyst", "createdby", "closedby", "actor",
]
CSV_DOMAIN = [
    "domain",
]
CSV_HOST = [
    "host", "device", "machine", "computer", "asset", "attacker", "target", "source", "destination", "network", "ip",
]
PS_VERBS = [
    "get", "set", "new", "add", "remove", "convertto", "convertfrom", "invoke", "import", "export", "start", "stop", "select", "where",
    "foreach", "out", "write", "read", "test", "enter", "exit", "connect", "disconnect", "enable", "disable", "update", "install", "uninstall",
    "copy", "move", "rename", "restart", "join", "split", "format", "measure", "sort", "group", "send", "receive", "register", "unregister",
    "resolve", "search", "find", "clear", "push", "pop", "compare", "show", "wait", "restore", "save",
]
PS_COLUMN_USER = [
    "samaccountname", "userprincipalname", "givenname", "surname", "fullname", "primaryownername", "principalname", "alias", "emailaddress",
    "mailbox", "accountname", "member", "manager", "identity",
]
PS_COLUMN_CONTEXT = [
    "displayname", "name",
]
PS_COLUMN_HOST = [
    "dnshostname", "pscomputername", "machinename", "servername", "computername", "hostname", "vmname", "nodename",
]
PS_ACCOUNT_TABLE = [
    "enabled", "principalsource", "samaccountname", "passwordrequired", "userprincipalname", "objectclass", "lastlogon", "sid", "surname",
    "givenname",
]
PS_MACHINE_TABLE = [
    "primaryownername", "manufacturer", "model", "osarchitecture", "totalphysicalmemory", "dnshostname", "domain",
]
PS_SOFTWARE_TABLE = [
    "status", "handles", "cpu", "processname", "starttype", "servicetype", "lastwritetime", "length", "mode", "version", "installdate",
    "publisher",
]
PS_CONTEXT_PARAMETERS = [
    "name", "displayname",
]
GENERIC_DOMAIN_WORDS = [
    "storage", "finance", "security", "network", "backup", "system", "service", "services", "support", "office", "cloud", "group", "home",
    "main", "test", "users", "admin", "enterprise", "global", "internal", "external", "primary", "secondary", "production", "development",
    "marketing", "sales", "legal", "media", "data", "web", "mail",
]

# Single patterns.
SHORT_SID = r"(?i)S-1-\d+(?:-\d+){0,3}"
PATH_FILE = r"(?i)\.(?:exe|dll|sys|drv|ocx|cpl|scr|com|msi|msu|cab|inf|ini|config|ps1|psm1|psd1|vbs|vbe|js|jse|wsf|bat|cmd|sh|py|jar|log|txt|xml|json|csv|dat|db|tmp|zip|7z|rar|lnk)$"
HEADERISH = r"^[A-Za-z][\w .\-]{0,60}$"
FULL_IP = r"(?:\d{1,3}\.){3}\d{1,3}"
FULL_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PS_NOT_A_VALUE = r"^(?:\$[A-Za-z_]\w*|\$_|@[{(]|-[A-Za-z])"
PS_NOT_A_SECRET = r"^(?:@[{(]|-[A-Za-z])"
PS_NAME_CMDLET = r"(?i)(?<![\w-])[A-Za-z]+-(?:AD|Az|Mg|Msol|Local)?(User|ADUser|Mailbox|Person|Contact|Group|ADGroup|VM|Computer|ADComputer)\b"
PS_PARAMETER = r"""(?i)(?<![\w-])--?([A-Za-z][A-Za-z\-]{1,23})[ \t]+(?=[\"']?[A-Za-z0-9])"""
PS_ITEM = r"[A-Za-z0-9][A-Za-z0-9._\\@$\-]*"
PS_RULER = r"^[ \t]*-{2,}(?:[ \t]+-{2,})+[ \t]*$"
PS_ENCODED = r"(?i)(?<![\w-])-(?:e|ec|enc|encoded|encodedcommand)[ \t]+([A-Za-z0-9+/]{40,}={0,2})"
TOKEN = r"[A-Za-z0-9_][A-Za-z0-9._\-@$]*"
TOKEN_QUALIFIED = r"[A-Za-z0-9_][A-Za-z0-9._\-@$]*(?:\\+[A-Za-z0-9._\-@$]+)+"
MACHINE_ISH = r"^(?=.*[\d-])[A-Za-z0-9][A-Za-z0-9\-]{3,}$"

# Labels of PowerShell parameters (plurals follow by rule), of the noun of a cmdlet, and labels in order of rank.
PS_PARAMETERS = {
    "HOST": "computername cn pscomputername hostname dnshostname machinename server servername serverinstance node vmname clustername smtpserver connectionuri",
    "RESOURCE": "resourcegroup resourcegroupname vaultname keyvaultname storageaccountname workspacename subscriptionname",
    "USER": "username user credential identity samaccountname mailbox userprincipalname accountname owner member sender manager givenname surname firstname lastname emailaddress",
    "ADDRESS": "streetaddress postalcode",
}
PS_NOUNS = {
    "USER": "user aduser mailbox person contact group adgroup",
    "HOST": "vm computer adcomputer",
}
LABELS = "CUSTOM EMAIL SID DN APIKEY KEYID ARN SECRET ACCTID UUID MAC IP IPV6 PHONE ADDRESS SERIAL ENCODED RESOURCE USER DOMAIN ASSET ORG GROUP SUBJECT HOST CC HASH".split()

# What each rule selects.
NOTES = {
    "windows-sid": 'domain SIDs with ≥4 sub-authorities; well-known short SIDs fall through',
    "azure-resource-id": 'quoted JSON resource-id value, whole string as one token',
    "aws-arn": 'ARN that carries a 12-digit account; account-less vendor ARNs do not match',
    "cloud-resource-name": 'quoted JSON resource-name path (Config / GCP)',
    "credit-card": '13–16 digit run with optional space/dash; Luhn-gated in accept. May swallow ONE trailing separator before a word char',
    "api-keys": 'known vendor key prefixes (sk-, AKIA, gh?_, xox?-, AIza)',
    "aws-principal-id": 'IAM unique ids / STS temp keys by 4-char prefix',
    "saas-object-id": 'Okta 00u/00g/00o/0oa ids and Duo D? ids',
    "saas-object-id-kv": '24-char id under a quoted *id key',
    "cloud-account-id": '4–20 digits under account/tenant/customer/subscriber/org id key',
    "saas-user-id-num": '4–20 digits under quoted *user_id key',
    "secret-kv": 'password/token/secret/api-key/auth/community/client-id = value',
    "ps-securestring": 'literal handed to ConvertTo-SecureString',
    "ps-secret-param": '-Password/-Token/… space-separated argument',
    "net-use-password": 'positional word after /user:X',
    "az-login-secret": '-p argument, only on an az login line',
    "bearer-token": '≥16-char token after Bearer',
    "serial-kv": 'sn= / serial= value ≥6 chars',
    "watchguard-serial": '12–16 hex after BSD-syslog host, before "("',
    "uuid": '8-4-4-4-12 hex',
    "hex-blob": '≥32 hex run',
    "email": 'mailbox@domain.tld',
    "sysmon-user": '"(Parent|Source|Target|Original)?User: …" whole line value',
    "sysmon-user-xml": 'same fields in <Data Name=…>',
    "sysmon-user-json": 'same fields, quoted JSON (prefix required)',
    "sysmon-hostname": 'Source/DestinationHostname line value',
    "sysmon-dns-query": 'QueryName line value',
    "sysmon-hostname-xml": 'Source/DestinationHostname XML',
    "sysmon-dns-query-xml": 'QueryName XML',
    "sysmon-host-json": 'hostname/QueryName JSON',
    "saas-actor-kv": 'actor/author/operator/…By/*user_name quoted values',
    "saas-actor-object": 'name inside actor/user/… object (no nested braces)',
    "group-name-kv": 'group/zone/policy/role name, ≤120 chars, ends at 2 spaces/tab/punct',
    "org-unit-kv": 'department/division/team/business-unit JSON',
    "group-object": 'name inside objectItem/group/team/role object',
    "cef-custom-label": 'csNLabel=<policy|rule|…> … csN=value; value is LAST group, N tied by back-reference',
    "org-tenant-kv": 'org/organization/business/tenant/workspace/company/customer JSON',
    "subject-topic-kv": 'topic/operation-detail/session-name JSON (mail subject excluded on purpose)',
    "ad-dn": '≥2 CN/OU/DC components as one token',
    "winxml-user": 'Security-channel user fields XML',
    "winxml-domain": 'Security-channel domain fields XML',
    "winevent-user": 'indented "Account Name:"-family line value',
    "winevent-domain": 'indented "Account Domain:"-family line value',
    "profile-path-user": 'folder after \\Users\\ (1+ backslashes)',
    "home-path-user": 'folder after /home/ or /Users/',
    "user-kv": 'generic user/login/account/uid/identity/target = value; rejects "key =" look-alike',
    "domain-kv": 'account/domain/logon domain = value',
    "get-credential-user": 'quoted name handed to Get-Credential',
    "graph-filter-user": 'quoted value of a Graph or Exchange eq filter',
    "ps-person-field": 'person field of a Format-List line',
    "user-at-ip": 'user part of user@IPv4',
    "epoxml-user": '<UserName>-family element text',
    "epoxml-domain": '<DomainName>-family element text',
    "displayname-json": 'quoted (user)displayName; appDisplayName excluded by the quote anchor',
    "sshd-auth-user": '"password|publickey|keyboard-interactive for [invalid user] X from"',
    "pam-session-user": '"session opened|closed for user X"',
    "pam-by-user": '"by X(uid="',
    "sudo-user": '"sudo: X :"',
    "user-token": '"user X" followed by @ / " -" / " logged" / " from"',
    "netscaler-context": '"Context X@"',
    "access-log-authuser": 'combined access-log 3rd field, must start with a letter',
    "squid-user": 'squid native ident field',
    "qradar-offense-source": 'offense_source key value',
    "quoted-user": "user 'X' / username 'X'",
    "domain-backslash-user": 'DOMAIN\\user incl. dotted domain, rejects path context and built-in group tails',
    "phone": '+country… E.164-like',
    "mac": '6 octets : or -',
    "ipv6": '8 full groups or a "::" form; avoids HH:MM:SS',
    "ipv4": 'dotted quad not preceded by word char or dot',
    "winevent-host": 'indented Workstation/Computer-family line value',
    "winxml-host": 'Workstation/MachineName XML',
    "winxml-computer": "the machine that an event's XML names",
    "syslog-bsd-host": 'token after "Mon dd HH:MM:SS", line start or after a quote',
    "cli-host-param": '-computername/-server/-node/… argument',
    "cloud-asset-kv": 'repo/project/environment/bucket/app/service/site/… JSON values',
    "cef-service-name": '(source|destination)ServiceName= value',
    "s3-access-bucket": 'bucket after 64-hex owner id at line start',
    "s3-access-key": 'object key after REST.VERB.RESOURCE',
    "azure-blob-path": 'path part of *.core.windows.net URLs',
    "s3-url-path": 'path part of s3…amazonaws.com URLs',
    "sharepoint-path": 'path part of *.sharepoint.com URLs, spaces allowed',
    "host-kv": '*host/computer/server/node/machine/devname/devid/device name = value',
    "epoxml-host": '<MachineName>-family element',
    "qualys-xml-host": '<NETBIOS>/<DNS>/<FQDN> element',
    "host-in-prose": 'UPPER-DASHED asset after host/server/… keyword, optional FQDN tail',
    "ps-transcript-name": 'host in PowerShell_transcript.<host>. filename',
    "dhcpd-host": '"(X) via"',
    "unc-host": 'server of \\\\server\\share, 2–4 backslashes, not inside escaped path',
    "compromised-entity": 'quoted compromisedEntity',
    "wazuh-agent-json": 'name inside agent/manager/cluster/node object',
    "agent-name-kv": 'quoted agent name; User-Agent excluded',
    "wazuh-alert-host": '"(X) ip->module"',
    "syslog-iso-host": 'token after ISO/RFC5424 timestamp at line start',
    "meraki-host": 'token after 10-digit epoch at line start',
    "path-domain": 'domain right after "/", with one of a short list of suffixes',
    "fqdn": 'dotted name with alphabetic last label; not after / \\ . - unless after //',
}

#: What labels are called in tables.
FIELD_NAMES = {
    "USER": "Username", "DOMAIN": "Domain", "EMAIL": "Email", "HOST": "Hostname / device",
    "IP": "IPv4 address", "IPV6": "IPv6 address", "MAC": "MAC address", "DN": "AD DN",
    "SID": "Windows SID", "PHONE": "Phone number", "SECRET": "Secret / password",
    "APIKEY": "API key", "UUID": "UUID / GUID", "HASH": "Hash / hex blob",
    "CC": "Card-like number", "SERIAL": "Device serial", "RESOURCE": "Cloud resource",
    "ARN": "AWS ARN", "ASSET": "Cloud / SaaS asset", "ORG": "Organisation / tenant",
    "GROUP": "Group / policy", "SUBJECT": "Topic / operation", "KEYID": "Vendor key id",
    "ACCTID": "Account / tenant number",
    "CUSTOM": "Custom term",
}
