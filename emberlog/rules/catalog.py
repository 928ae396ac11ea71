"""The detection rules: what each looks at, and what it means.

R: a pattern over one field of an event. T: a number of events, or of distinct values, of one key
in a window. S: steps in order for one key in a window.
"""

from .model import R, S, T

# Rule numbers, names, grades, confidences, fields, patterns, filters, counts and windows,
# with tactic and technique numbers.
RULES = [
    # ai_attack
    R("AI-001", 'Direct Prompt Injection in HTTP Request', "HIGH", "ai_attack", 0.83, "AML.TA0000/AML.T0051", "http_uri_decoded source_ip http_user_agent",
      "http_uri_decoded", r"(?i)(ignore\s+(previous|all|above|prior)\s+(instructions?|prompts?|context)|system\s*prompt:|you\s+are\s+now\s+(a|an)\s+|disregard\s+(all\s+)?(previous|prior|above)|forget\s+your\s+(instructions?|training|rules)|\[INST\]|\[\/INST\]|JAILBREAK|DAN\s*mode|developer\s+mode\s+enabled|act\s+as\s+(DAN|AIM|STAN))"),
    R("AI-002", 'Indirect Prompt Injection via Log Fields', "CRITICAL", "ai_attack", 0.85, "AML.TA0000/AML.T0051", "http_user_agent source_ip http_uri",
      "http_user_agent", r"(?i)(ignore\s+(previous|all)\s+instructions?|system\s*prompt:|you\s+are\s+now|\[INST\]|\[SYS\]|forget\s+your|disregard\s+(all|prior)|###\s*Instruction|OVERRIDE\s+MODE)"),
    T("AI-003", 'LLM API Endpoint Rate Probe', "MEDIUM", "ai_attack", 0.75, "AML.TA0000/AML.T0043", "source_ip http_uri http_user_agent", "source_ip", 20, 60, {'http_status_in': [200, 400, 401, 429]}, None),
    R("AI-004", 'Training Data / System Prompt Extraction', "HIGH", "ai_attack", 0.78, "AML.TA0000/AML.T0037", "http_uri_decoded source_ip http_user_agent",
      "http_uri_decoded", r"(?i)(repeat\s+(the\s+)?(exact\s+)?(words?|text|training)\s+|what\s+(is\s+)?(your\s+)?(system\s+prompt|instructions?)|tell\s+me\s+your\s+(initial\s+)?(prompt|instructions?)|print\s+your\s+(system\s+)?instructions?|output\s+your\s+(training\s+)?data|reveal\s+(your\s+)?(prompt|instructions?))"),
    R("AI-005", 'MCP Tool Call Anomaly', "HIGH", "ai_attack", 0.82, "AML.TA0000/AML.T0051", "source_ip message http_user_agent",
      "message", r"(?i)(mcp.*tool.*call.*(bash|shell|exec|system|eval)|mcp.*filesystem.*\.\.|mcp.*read_file.*/etc/|mcp.*write_file.*/tmp/|tool_use.*execute.*command|mcp.*subprocess)"),
    R("AI-006", 'AI API Key Exposed in Logs', "CRITICAL", "ai_attack", 0.92, "TA0006/T1552.001", "source_ip message http_user_agent",
      "message", r"(?i)(sk-[a-zA-Z0-9]{32,}|sk-ant-[a-zA-Z0-9\-_]{40,}|hf_[a-zA-Z0-9]{30,}|AIza[a-zA-Z0-9\-_]{35}|Authorization:\s*Bearer\s+sk-|x-api-key:\s*sk-)"),
    R("AI-007", 'LLM Jailbreak Attempt', "MEDIUM", "ai_attack", 0.8, "AML.TA0000/AML.T0051", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)(\bDAN\b.*mode|do\s+anything\s+now|jailbreak|uncensored\s+model|grandma\s+(exploit|trick)|pretend\s+you\s+have\s+no\s+(restrictions?|limits?|filters?)|evil\s+(mode|version|twin)|as\s+an?\s+AI\s+with\s+no\s+restrictions?)"),
    R("AI-008", 'Vector DB / RAG Store Poisoning Probe', "HIGH", "ai_attack", 0.73, "AML.TA0000/AML.T0043", "source_ip http_uri_decoded http_user_agent",
      "http_uri_decoded", r"(?i)(\/embed(dings?)?|\/upsert|\/add_texts|\/collections\/.*\/points|chromadb|pinecone|weaviate|qdrant|vectorstore.*add|index.*payload.*ignore\s+previous)"),
    # api_attack
    R("API-001", 'GraphQL Introspection Abuse', "MEDIUM", "api_attack", 0.82, "TA0043/T1595", "source_ip http_uri_decoded http_user_agent",
      "http_uri_decoded", r"(?i)(\{__schema|\{__type|__schema\s*\{|__type\s*\{|query.*__schema.*types|introspectionquery|\{__typename|schema.*fields.*name.*type)"),
    R("API-002", 'GraphQL Injection / Batching Attack', "HIGH", "api_attack", 0.8, "TA0006/T1110", "source_ip http_uri_decoded",
      "http_uri_decoded", r"(?i)(\[.*\{.*mutation.*login.*\}.*\{.*mutation.*login|alias\d+\s*:\s*\w+|query.*\$.*UNION|fragment.*on.*__Schema|.*\{.*\$.*\}\s*\{.*\$|mutation.*\{.*login.*password.*\}.*mutation.*\{.*login)"),
    R("API-003", 'API Version Downgrade Attack', "MEDIUM", "api_attack", 0.72, "TA0001/T1190", "source_ip http_uri_decoded http_method",
      "http_uri_decoded", r"(?i)(\/api\/v[01](\/|$)|\/api\/v1\.0(\/|$)|\/api\/beta\/(admin|users|internal)|\/api\/legacy\/|\/api\/old\/|\/v1\/(internal|admin|debug)|\/rest\/v1\/admin)"),
    R("API-004", 'Mass Assignment / Parameter Pollution', "HIGH", "api_attack", 0.78, "TA0004/T1190", "source_ip http_uri_decoded username http_method",
      "http_uri_decoded", r'(?i)("(isAdmin|is_admin|role|privilege|admin|verified|approved|activated|balance|credit|group_id|permission|scope|access_level)"\s*:\s*(true|1|"admin"|"superuser"|"root")|(isAdmin|is_admin|role|admin)=true|privilege=(admin|root|superadmin))'),
    R("API-005", 'Broken Function Level Authorization', "HIGH", "api_attack", 0.8, "TA0004/T1190", "source_ip username http_uri_decoded http_method",
      "http_uri_decoded", r"(?i)(\/api\/.*(admin|internal|management|superuser|privileged)\/|\/admin\/api\/|\/api\/admin\/|DELETE\s+\/api\/v[0-9]+\/users\/|PUT\s+\/api\/v[0-9]+\/(roles|permissions|groups)\/|PATCH\s+\/api\/v[0-9]+\/users\/[^\/]+\/(role|permission))"),
    R("API-006", 'API Rate Limit Bypass Attempt', "MEDIUM", "api_attack", 0.73, "TA0006/T1110", "source_ip message http_uri",
      "message", r"(?i)(X-Forwarded-For:\s*([0-9]{1,3}\.){3}[0-9]{1,3},\s*([0-9]{1,3}\.){3}[0-9]{1,3}|X-Real-IP.*X-Forwarded-For|Client-IP.*127\.0\.0\.1|X-Originating-IP.*127\.|CF-Connecting-IP.*127\.|429.*retry-after.*0)"),
    R("API-007", 'Unrestricted Resource Consumption â€” Large Payload', "MEDIUM", "api_attack", 0.7, "TA0040/T1499", "source_ip http_uri http_bytes http_method",
      "http_bytes", r"^[1-9]\d{7,}$", {'http_method': 'POST'}),
    R("API-008", 'Server-Sent Events / WebSocket Hijacking', "HIGH", "api_attack", 0.75, "TA0006/T1539", "source_ip message http_uri",
      "message", r"(?i)(Upgrade:\s*websocket.*Origin:\s*null|Upgrade:\s*websocket.*Origin:\s*https?://(?!.*same-origin)|text\/event-stream.*Origin:\s*null|websocket.*CSWSH|cross.site.*websocket|Upgrade:\s*websocket\s*\n(?!.*Origin:))"),
    R("API-009", 'Swagger / OpenAPI Spec Public Exposure', "LOW", "api_attack", 0.68, "TA0043/T1595", "source_ip http_uri_decoded http_user_agent",
      "http_uri_decoded", r"(?i)(\/swagger(-ui)?(\.html|\.json|\/|$)|\/openapi\.(json|yaml)(\/|$)|\/api-docs(\/|$)|\/v[23]\/api-docs|\/swagger\/v[0-9]+\/swagger\.json|\/redoc(\/|$)|\/rapidoc(\/|$)|\/api\/schema\.(json|yaml))"),
    # auth
    T("AUTH-001", 'SSH Brute Force', "HIGH", "auth", 0.9, "TA0006/T1110.001", "source_ip username", "source_ip", 5, 60, {'auth_result': 'failure', 'process_name_contains': 'sshd'}, None),
    S("AUTH-002", 'SSH Root Compromise', "CRITICAL", "auth", 0.95, "TA0001/T1078.003 TA0004/T1078", "source_ip username", "source_ip", 300, [{'match_field': 'auth_result', 'value': 'failure', 'match_field2': 'username', 'value2': 'root', 'min_count': 1}, {'match_field': 'auth_result', 'value': 'success', 'match_field2': 'username', 'value2': 'root'}]),
    T("AUTH-003", 'Web Login Brute Force', "HIGH", "auth", 0.85, "TA0006/T1110.004", "source_ip http_uri username", "source_ip", 10, 60, {'http_status_in': [401, 403]}, None),
    T("AUTH-004", 'Windows Failed Logon Spike (4625)', "HIGH", "auth", 0.88, "TA0006/T1110.003", "source_ip username", "source_ip", 5, 120, {'event_id': '4625'}, None),
    R("AUTH-005", 'Internal IP Authentication Failure', "MEDIUM", "auth", 0.7, "TA0008/T1021", "source_ip username",
      "source_ip", r"^(10\.\d+\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+)$", {'auth_result': 'failure'}),
    R("AUTH-006", 'Audit Log Cleared (1102)', "CRITICAL", "auth", 0.99, "TA0005/T1070.001", "hostname username timestamp",
      "event_id", r"^1102$"),
    R("AUTH-007", 'JWT Algorithm Downgrade (alg:none)', "CRITICAL", "auth", 0.92, "TA0006/T1550.004", "source_ip http_user_agent message",
      "message", r'(?i)(eyJ[a-zA-Z0-9_-]*\.(eyJ[a-zA-Z0-9_-]*)\.\s*$|"alg"\s*:\s*"none"|"alg"\s*:\s*"None"|alg=none|algorithm.*none|eyJhbGciOiJub25lIi)'),
    T("AUTH-008", 'OAuth / Token Endpoint Abuse', "HIGH", "auth", 0.8, "TA0006/T1110", "source_ip http_uri", "source_ip", 15, 60, {'http_status_in': [400, 401, 403]}, None),
    T("AUTH-009", 'Credential Stuffing Pattern', "HIGH", "auth", 0.82, "TA0006/T1110.004", "source_ip username", "source_ip", 8, 120, {'auth_result': 'failure'}, 'username'),
    T("AUTH-010", 'MFA / OTP Brute Force', "HIGH", "auth", 0.83, "TA0006/T1110", "source_ip http_uri", "source_ip", 10, 60, {'http_status_in': [400, 401, 403]}, None),
    # bot_activity
    R("BOT-001", 'Headless Browser / Automation Tool', "MEDIUM", "bot_activity", 0.88, "TA0043/T1595", "source_ip http_user_agent http_uri",
      "http_user_agent", r"(?i)(HeadlessChrome|PhantomJS|Selenium|WebDriver|puppeteer|playwright|Nightmare|zombie\.js|htmlunit|httpclient|requests\s+library|python-httpx|mechanize|scrapy|Chrome/[0-9]+.*HeadlessChrome|--headless|phantom|slimerjs)"),
    T("BOT-002", 'High-Rate Request Flooding (Single IP)', "HIGH", "bot_activity", 0.85, "TA0040/T1499", "source_ip http_user_agent", "source_ip", 100, 10, {}, None),
    R("BOT-003", 'Missing or Blank User-Agent', "LOW", "bot_activity", 0.7, "TA0043/T1595", "source_ip http_uri",
      "http_user_agent", r"^(-|\\s*)$"),
    T("BOT-004", 'Credential Stuffing Bot Pattern', "HIGH", "bot_activity", 0.87, "TA0006/T1110.004", "source_ip http_uri http_user_agent", "source_ip", 50, 60, {'http_status_in': [401, 403, 200]}, 'username'),
    T("BOT-005", 'Web Scraper Content Harvesting', "LOW", "bot_activity", 0.68, "TA0009/T1213", "source_ip http_user_agent", "source_ip", 200, 300, {'http_status_in': [200]}, None),
    R("BOT-006", 'Vulnerability Scanner Fingerprint', "HIGH", "bot_activity", 0.82, "TA0043/T1595.002", "source_ip http_uri_decoded http_user_agent",
      "http_uri_decoded", r"(?i)(\/wp-login\.php|\/wp-admin\/|\/phpmyadmin\/|\/adminer\.php|\/manager\/html|\/jmx-console|\/solr\/admin|\/console\/login|\/\.env$|\/config\.php\.bak|\/web\.config\.bak|\/backup\.sql|\/dump\.sql|\/db\.sql|\/credentials\.txt|\/passwords\.txt|\/\.git\/config$|\/\.svn\/entries$|\/actuator\/env|\/actuator\/heapdump)"),
    T("BOT-007", 'Distributed Bot Attack (Many IPs Same Target)', "HIGH", "bot_activity", 0.8, "TA0040/T1499.003", "http_uri http_user_agent", "http_uri", 50, 300, {}, 'source_ip'),
    # cloud_attack
    R("CLOUD-001", 'AWS IMDSv1 Metadata Credential Theft', "CRITICAL", "cloud_attack", 0.9, "TA0006/T1552.005", "source_ip http_uri_decoded http_user_agent",
      "http_uri_decoded", r"(?i)(169\.254\.169\.254/latest/(meta-data|dynamic|user-data)|169\.254\.169\.254/latest/meta-data/iam/security-credentials|metadata\.google\.internal/computeMetadata|169\.254\.169\.254/metadata/instance)"),
    R("CLOUD-002", 'AWS CloudTrail High-Risk API Call', "HIGH", "cloud_attack", 0.88, "TA0004/T1078.004", "source_ip username message",
      "message", r"(?i)(AttachUserPolicy|AttachRolePolicy|CreateAccessKey|DeleteAccessKey|StopLogging|DeleteTrail|UpdateTrail|AuthorizeSecurityGroupIngress|DeleteFlowLogs|PutBucketPolicy.*public|CreateLoginProfile|UpdateLoginProfile|PutRolePolicy.*AdministratorAccess)"),
    R("CLOUD-003", 'Kubernetes Privileged Pod / HostPath Mount', "CRITICAL", "cloud_attack", 0.88, "TA0004/T1611", "hostname username message",
      "message", r"(?i)(hostPath.*path.*/(etc|proc|sys|var|root)|hostPID:\s*true|hostNetwork:\s*true|hostIPC:\s*true|privileged:\s*true|allowPrivilegeEscalation:\s*true|mountPath.*\/host)"),
    R("CLOUD-004", 'Docker Socket Mounted in Container', "CRITICAL", "cloud_attack", 0.92, "TA0004/T1611", "hostname message",
      "message", r"(?i)(\/var\/run\/docker\.sock|-v\s+\/var\/run\/docker\.sock|docker\.sock.*Bind|hostPath.*docker\.sock)"),
    R("CLOUD-005", 'Kubernetes Service Account Token Theft', "CRITICAL", "cloud_attack", 0.87, "TA0006/T1528", "source_ip http_uri_decoded hostname",
      "http_uri_decoded", r"(?i)(\/var\/run\/secrets\/kubernetes\.io\/serviceaccount|serviceaccount\/token|kubernetes\.io\/service-account-token)"),
    R("CLOUD-006", 'AWS Root Account Usage', "CRITICAL", "cloud_attack", 0.97, "TA0001/T1078.004", "source_ip message",
      "message", r'(?i)("type"\s*:\s*"Root"|userIdentity.*Root|root.*ConsoleLogin|"userName"\s*:\s*"root")'),
    R("CLOUD-007", 'Kubectl Exec into Running Pod', "HIGH", "cloud_attack", 0.8, "TA0002/T1609", "source_ip username message hostname",
      "message", r"(?i)(kubectl\s+exec|\/api\/v1\/namespaces\/.*\/pods\/.*\/exec|pods\/exec\s+UPGRADE|exec.*stdin.*stdout.*tty)"),
    R("CLOUD-008", 'GCP / Azure Metadata SSRF Probe', "HIGH", "cloud_attack", 0.88, "TA0006/T1552.005", "source_ip http_uri_decoded",
      "http_uri_decoded", r"(?i)(metadata\.google\.internal|169\.254\.169\.254/metadata|http://169\.254\.169\.254|Metadata-Flavor.*Google|metadata\.azure\.internal|imds\.azure\.internal)"),
    R("CLOUD-009", 'Lambda / Serverless Secrets Exposure', "HIGH", "cloud_attack", 0.78, "TA0009/T1213", "source_ip username message",
      "message", r"(?i)(GetFunction\b|ListFunctions\b|GetFunctionConfiguration|lambda.*environment.*variables|InvokeFunction.*payload|UpdateFunctionCode)"),
    # defense_evasion
    R("EVA-001", 'Windows Event Log Service Stopped', "CRITICAL", "defense_evasion", 0.95, "TA0005/T1562.002", "hostname username message",
      "message", r"(?i)(EventID.*(7036|7040).*EventLog|Windows\s+Event\s+Log.*stopped|sc\s+(stop|config|delete)\s+EventLog|net\s+stop\s+EventLog|Set-Service.*EventLog.*Disabled|wevtutil.*sl.*enabled.*false)"),
    R("EVA-002", 'Sysmon / AV / EDR Service Killed', "CRITICAL", "defense_evasion", 0.93, "TA0005/T1562.001", "hostname username message process_name",
      "message", r"(?i)(sc\s+(stop|delete)\s+(sysmon|MsMpSvc|WinDefend|SentinelAgent|CsFalconService|cbdefense|csagent|MBAMService|avast|avg|mcafee|symantec)|net\s+stop\s+(sysmon|MsMpSvc|WinDefend|csagent)|taskkill.*\/f.*(sysmon|MsMpEng|SentinelOne|falcon)|Unloading\s+Sysmon|HKLM.*SYSTEM.*CurrentControlSet.*Services.*Sysmon.*Delete)"),
    R("EVA-003", 'Timestomping â€” File Timestamp Modification', "HIGH", "defense_evasion", 0.85, "TA0005/T1070.006", "hostname username message",
      "message", r"(?i)(Sysmon.*EventID.*2|file\s+creation\s+time\s+changed|touch\s+-[drtm]|SetFileTime|NtSetInformationFile.*BasicInfo|timestomp|powershell.*\[io\.file\].*SetLastWriteTime|\[system\.io\.file\]::SetCreationTime|\[system\.io\.file\]::SetLastAccessTime)"),
    R("EVA-004", 'Bash History Cleared or Disabled', "HIGH", "defense_evasion", 0.88, "TA0005/T1070.003", "hostname username message",
      "message", r"(?i)(unset\s+HISTFILE|HISTFILE=\/dev\/null|HISTSIZE=0|HISTFILESIZE=0|history\s+-[cwn]|>\s*~\/\.bash_history|cat\s+\/dev\/null\s*>\s*.*\.bash_history|rm\s+(~\/)?\.bash_history|export\s+HISTIGNORE=\*|set\s+\+o\s+history)"),
    R("EVA-005", 'Process Hollowing / Injection Indicator', "CRITICAL", "defense_evasion", 0.82, "TA0005/T1055", "hostname message process_name",
      "message", r"(?i)(CreateRemoteThread|VirtualAllocEx|WriteProcessMemory|Sysmon.*EventID.*8|SourceImage.*(svchost|explorer|notepad|msiexec|dllhost|rundll32).*TargetImage.*(cmd|powershell|wscript|cscript|mshta|wmic|regsvr32)|Hollowing|process\s+injection|mavinject|Process\s+Ghosting|AtomBombing|QueueUserAPC.*shellcode)"),
    R("EVA-006", 'AMSI / ETW Bypass Attempt', "CRITICAL", "defense_evasion", 0.9, "TA0005/T1562.001", "hostname username message",
      "message", r"(?i)(\[Ref\]\.Assembly\.GetType.*amsi|amsiInitFailed|amsiContext|\[Runtime\.InteropServices\.Marshal\]::Copy.*amsi|Set-MpPreference.*DisableRealtimeMonitoring|Add-MpPreference.*ExclusionPath|\[System\.Diagnostics\.Eventing.*provider.*0\]|ETWEventWrite.*0|EtwpCreateEtwThread)"),
    R("EVA-007", 'Double URL / Unicode Encoding Evasion', "MEDIUM", "defense_evasion", 0.8, "TA0005/T1027", "source_ip http_uri http_user_agent",
      "http_uri", r"(?i)(%25[2-7][0-9a-f]|%252[0-9a-f]|%u00[0-9a-f]{2}|%u[0-9a-f]{4}|%00|\\x00|\\u0000|\.\./.*%2[ef]|%[0-9a-f]{2}%[0-9a-f]{2}%[0-9a-f]{2}%[0-9a-f]{2}%[0-9a-f]{2})"),
    R("EVA-008", 'Alternate Data Stream (ADS) Usage', "HIGH", "defense_evasion", 0.85, "TA0005/T1564.004", "hostname username message",
      "message", r"(?i)(Sysmon.*EventID.*15|AlternateDataStream|zone\.identifier|:\s*(payload|hidden|stream|data|exec)\s*$|type\s+.*\s*>\s*[^:]+:[^:]+|more\s*<\s*[^:]+:[^:]+|wscript.*[^:]+:[^:]+\.js|echo.*>\s*[^\s:]+:[^\s:]+)"),
    # discovery
    R("DISC-001", 'System Information Discovery (T1082)', "MEDIUM", "discovery", 0.8, "TA0007/T1082", "hostname username message process_name",
      "message", r"(?i)((whoami|hostname|systeminfo|uname\s+-a|id\s*$|cat\s+\/etc\/os-release|lsb_release|ipconfig\s*(\/all)?|ifconfig|ip\s+addr|ver\s*$|winver)\s*(&&|\|\||;|\n)|cmd.*\/c\s+(whoami|hostname|systeminfo)|powershell.*\(Get-WmiObject\s+Win32_OperatingSystem\)|Get-ComputerInfo|(whoami|id)\s*>\s*[\w\/\\]+)"),
    R("DISC-002", 'Network Service Scanning from Compromised Host (T1046)', "HIGH", "discovery", 0.85, "TA0007/T1046", "hostname username message",
      "message", r"(?i)(nmap\s+(-s[STUVA]|-p\s+\d|\-\-scan-delay|-O\s|--os-detection|\-A\s)|masscan\s+.*-p|netstat\s+-a(n)?[ot]?|ss\s+-tulnp|arp\s+-a|arp-scan|for\s+.*in\s+.*ping|1..254.*ping|ping\s+-c\s+1.*\d{1,3}\.\d{1,3}|fping\s+-a|invoke-portscan|test-netconnection.*-port)"),
    R("DISC-003", 'Remote System / Host Discovery (T1018)', "HIGH", "discovery", 0.82, "TA0007/T1018", "hostname username message",
      "message", r"(?i)(net\s+view|net\s+view\s+\/domain|nltest\s+\/dclist:|nltest\s+\/dsgetdc:|Get-ADComputer.*Filter|nbtstat\s+-n|nbtstat\s+-r|arp\s+-a\s*$|ldapsearch.*objectClass.*computer|powerview.*Get-NetComputer|Get-NetNeighbor|AdFind.*objectclass.*computer)"),
    R("DISC-004", 'Process Discovery / Tasklist (T1057)', "LOW", "discovery", 0.72, "TA0007/T1057", "hostname username message",
      "message", r"(?i)(tasklist\s*(\/v|\/fo|\/m|\/svc)?|ps\s+(-aux|-ef|-e|-f|aux)\s*$|Get-Process\s*$|Get-WmiObject.*Win32_Process|wmic\s+process\s+list|pgrep\s+-a|qprocess\s+\*|powershell.*get-process.*name)"),
    R("DISC-005", 'Account and Group Enumeration (T1087 / T1069)', "MEDIUM", "discovery", 0.78, "TA0007/T1087", "hostname username message",
      "message", r'(?i)(net\s+user\s*(\/domain)?|net\s+localgroup\s+(administrators|"domainadmins"|"enterpriseadmins")|net\s+group\s+"DomainAdmins"|Get-ADUser.*Filter|Get-ADGroupMember|wmic\s+useraccount\s+list|cat\s+\/etc\/(passwd|group|shadow)|getent\s+(passwd|group)|id\s+-G|groups\s*$|whoami\s+\/groups|whoami\s+\/priv|AdFind.*objectclass.*user)'),
    R("DISC-006", 'Credential File / Secret Hunting', "HIGH", "discovery", 0.85, "TA0006/T1552.001", "hostname username message",
      "message", r'(?i)(find\s+\/\s+-name\s+.*\.(pem|key|p12|pfx|ppk|kdbx)|find\s+.*-name\s+"id_rsa"|find\s+.*-name\s+".*password.*"|find\s+.*-name\s+"\.env"|dir\s+\/s\s+\/b\s+.*password|dir\s+.*\.kdbx|dir\s+.*\.pfx|grep\s+-r\s+(password|passwd|secret|api_key|token)\s+\/|type\s+.*unattend\.xml|Get-ChildItem.*\.kdbx|findstr\s+\/si\s+password\s+.*\.(xml|ini|config|txt))'),
    R("DISC-007", 'Security Software / Defensive Tool Discovery', "MEDIUM", "discovery", 0.78, "TA0007/T1518.001", "hostname username message",
      "message", r"(?i)(Get-MpComputerStatus|Get-MpPreference|sc\s+query\s+(WinDefend|CsFalconService|SentinelAgent|cbdefense|MsMpSvc)|wmic.*antivirusproduct|WMIC.*AntiVirus|tasklist.*\/(v|fo).*crowdstrike|reg\s+query.*HKLM.*Security|netsh\s+advfirewall\s+show|Get-NetFirewallRule|iptables\s+-L|ufw\s+status)"),
    R("DISC-008", 'Log4Shell Exploitation Attempt (CVE-2021-44228)', "CRITICAL", "discovery", 0.96, "TA0001/T1190", "source_ip message http_user_agent http_uri_decoded",
      "http_user_agent", r"(?i)(\$\{jndi:(ldap|rmi|dns|corba|iiop|imap|ldaps|nds|nis|nns)://|\$\{jndi:|\$\{\$\{::-j\}|\$\{\$\{lower:j\}|\$\{\$\{upper:j\}|\$\{env:NaN:-j\}|CVE-2021-44228|log4shell|log4j.*exploit|\$\{j\$\{:\-n\}di:|\$\{j\$\{lower:n\}di:)"),
    # exfiltration
    R("EXFIL-001", 'Unusually Large HTTP Response', "MEDIUM", "exfiltration", 0.65, "TA0010/T1041", "source_ip http_uri http_bytes",
      "http_bytes", r"^[5-9]\d{6,}$|^\d{8,}$"),
    R("EXFIL-002", 'Programmatic / Headless Client User-Agent', "MEDIUM", "exfiltration", 0.6, "TA0011/T1071.001", "source_ip http_user_agent http_uri",
      "http_user_agent", r"(?i)^(python-urllib|python-httpx|python-requests|curl/[0-9]|wget/[0-9]|go-http-client|-|Java/[0-9]|Ruby|libcurl|PowerShell)"),
    R("EXFIL-003", 'DNS Tunneling Indicator', "HIGH", "exfiltration", 0.78, "TA0011/T1071.004", "source_ip message",
      "message", r"(?i)(query:\s+[a-z0-9]{50,}\.|NXDOMAIN.*[a-z0-9]{40,}\.|DNS.*TXT.*[a-z0-9]{30,})"),
    T("EXFIL-004", 'C2 Beaconing Pattern', "HIGH", "exfiltration", 0.7, "TA0011/T1071", "source_ip http_uri http_user_agent", "source_ip", 10, 600, {'http_status_in': [200]}, None),
    T("EXFIL-005", 'Staged Exfiltration â€” POST After Recon', "HIGH", "exfiltration", 0.75, "TA0010/T1048", "source_ip http_uri http_bytes", "source_ip", 3, 300, {'http_method': 'POST'}, None),
    R("EXFIL-006", 'Cloud Storage Exfiltration (S3 / GCS / Azure Blob)', "HIGH", "exfiltration", 0.78, "TA0010/T1567.002", "source_ip http_uri_decoded http_bytes http_method",
      "http_uri_decoded", r"(?i)(\.s3\.amazonaws\.com.*(PUT|POST)|storage\.googleapis\.com.*(PUT|POST)|\.blob\.core\.windows\.net.*(PUT|POST)|s3api\s+put-object|gsutil\s+cp.*gs://|az\s+storage\s+blob\s+upload)"),
    R("EXFIL-007", 'Steganography Exfiltration Indicator', "MEDIUM", "exfiltration", 0.6, "TA0010/T1048", "source_ip message hostname",
      "message", r"(?i)(steghide\s+embed|outguess\s+-d|stegsolve|stegosaurus|invisible\s+ink|openstego|snow\s+-C|exiftool.*-comment.*<payload|jpg.*size.*[5-9]\d{6,}|png.*size.*[3-9]\d{6,})"),
    R("EXFIL-008", 'Paste Site / Code Share Upload', "HIGH", "exfiltration", 0.72, "TA0010/T1567.003", "source_ip http_uri_decoded http_bytes",
      "http_uri_decoded", r"(?i)(pastebin\.com\/(api|post)|paste\.ee\/p\/|dpaste\.com\/|ghostbin\.co\/|hastebin\.com\/|gist\.github\.com\/|controlc\.com\/|paste\.ofcode\.org\/|privatebin\.net\/\?)", {'http_method': 'POST'}),
    # impact
    R("IMP-001", 'Ransomware Mass File Encryption (T1486)', "CRITICAL", "impact", 0.92, "TA0040/T1486", "hostname username message",
      "message", r"(?i)(\.encrypted$|\.locked$|\.enc$|\.crypt$|\.WNCRY|\.wcry|\.wnry|\.wannacry|\.RYUK|\.RYK|\.conti|\.CONTI|\.lockbit|\.LockBit|\.LOCK|\.REVIL|\.sodinokibi|\.BlackCat|\.ALPHV|\.cl0p|\.Clop|\.hive|\.readme.*\.txt|!!!.*READ.*!!!|HOW_TO_DECRYPT|RESTORE_FILES|mass.*rename.*\.(enc|locked|crypt)|file.*extension.*changed.*[0-9]{3,})"),
    R("IMP-002", 'Ransomware Ransom Note Creation', "CRITICAL", "impact", 0.95, "TA0040/T1486", "hostname username message",
      "message", r"(?i)(HOW_TO_DECRYPT\.(txt|html)|RESTORE_FILES\.(txt|html)|README_FOR_DECRYPT\.(txt|html)|_readme\.txt|!!!_HOW_TO_DECRYPT_!!!|RECOVERY_INSTRUCTIONS\.(txt|html)|.*decrypt.*instructions.*\.txt|.*ransom.*note.*\.txt|.*your.*files.*encrypted.*\.html)"),
    R("IMP-003", 'Wiper Malware â€” Disk / MBR Destruction (T1485)', "CRITICAL", "impact", 0.9, "TA0040/T1485", "hostname username message",
      "message", r"(?i)(dd\s+if=\/dev\/zero\s+of=\/dev\/[sh]d|dd\s+if=\/dev\/urandom\s+of=\/dev\/[sh]d|shred\s+-[uzn].*\/dev\/|wipe\s+-[qrf].*\/dev\/|diskpart.*clean\s+all|format\s+[cde]:\s+\/fs|sdelete.*-[pza].*\/|cipher\s+\/w:|NotPetya|WhisperGate|AcidRain|BootKit.*wipe|MBR.*overwrite|WriteFile.*\\\\\.\\\\PHYSICALDRIVE)"),
    T("IMP-004", 'Network Denial of Service / Flood (T1498)', "HIGH", "impact", 0.8, "TA0040/T1498.001", "source_ip dest_ip", "source_ip", 500, 10, {}, None),
    R("IMP-005", 'Critical Service Stopped / Disabled (T1489)', "CRITICAL", "impact", 0.85, "TA0040/T1489", "hostname username message",
      "message", r'(?i)((net\s+stop|sc\s+stop|sc\s+config.*disabled)\s+(mssqlserver|mysql|postgresql|oracle|"internetinformationservices"|w3svc|"windowsbackup"|wbengine|vss|swprv|sqlwriter|"sqlserver"|mongodb|redis|kafka|elasticsearch|"activedirectory"|ntds|kdc)|EventID.*7036.*(stopped|disabled).*(sql|iis|mysql|ntds|kdc)|service.*stopped.*(database|web\s+server|backup|domain))'),
    R("IMP-006", 'Website Defacement Pattern', "HIGH", "impact", 0.75, "TA0040/T1491.001", "hostname username message",
      "message", r"(?i)((index\.(html|php|asp|htm)|home\.(html|php))\s+(overwritten|modified|replaced|written)|(cp|mv|copy|move)\s+.*\s+(\/var\/www|C:\\inetpub|C:\\xampp\\htdocs).*index\.(html|php)|defac[ae]d|hacked\s+by|echo.*deface.*>\s*(\/var\/www|index\.html)|site.*replaced.*attacker)"),
    R("IMP-007", 'Firmware / Boot Record Attack', "CRITICAL", "impact", 0.87, "TA0040/T1542.003", "hostname username message",
      "message", r"(?i)(efibootmgr\s+-[cCdD]|flashrom\s+(-w|-r)\s+.*\.bin|bcdedit\s+\/set\s+.*safeboot|bcdedit.*bootsequence|bcdedit.*path.*bootmgfw\.efi|rweverything|RWEverything|UEFI.*write|SPI\s+flash.*write|LoJax|MosaicRegressor|CosmicStrand|SetVariable.*Global.*BootOrder)"),
    T("IMP-008", 'Log Flood / SIEM Overwhelm Attack', "HIGH", "impact", 0.75, "TA0005/T1562.006", "source_ip", "source_ip", 1000, 10, {}, None),
    # insider_threat
    R("INSD-001", 'Off-Hours Access to Sensitive Resource', "MEDIUM", "insider_threat", 0.68, "TA0009/T1213", "source_ip username http_uri_decoded timestamp",
      "http_uri_decoded", r"(?i)(\/admin(\/|$)|\/export(\/|\?|$)|\/reports?(\/|\?|$)|\/api\/(bulk|export|dump|download|backup)|\/data\/(export|download|dump)|\/backup(s)?(\/|$)|\/download.*\.(sql|csv|xlsx|zip|tar|gz)$)"),
    T("INSD-002", 'Bulk Data Export / Mass Download', "HIGH", "insider_threat", 0.75, "TA0009/T1005", "username source_ip http_uri", "username", 30, 600, {'http_status_in': [200]}, None),
    R("INSD-003", 'Database Mass SELECT / Dump Query', "HIGH", "insider_threat", 0.78, "TA0009/T1213", "username source_ip message",
      "message", r"(?i)(SELECT\s+\*\s+FROM\s+(users|customers|employees|credit_cards?|payments?|salaries|medical_records?|patients?|accounts?|orders?|secrets?|tokens?)\s*;|mysqldump\s+|pg_dump\s+|BACKUP\s+DATABASE|SELECT\s+.*INTO\s+OUTFILE|\bEXPORT\b.*\bTABLE\b|bcp\s+.*queryout)"),
    R("INSD-004", 'Privilege Use Outside Normal Pattern', "HIGH", "insider_threat", 0.72, "TA0004/T1078", "username source_ip hostname message",
      "message", r"(?i)(EventID.*4648|RunAs.*admin|sudo\s+(-u\s+root\s+)?(bash|sh|python|perl|wget|curl|nc)|su\s+-\s+root|Privilege\s+Use.*Special\s+Privileges|SeDebugPrivilege|SeTakeOwnershipPrivilege|SeLoadDriverPrivilege)"),
    R("INSD-005", 'USB / Removable Media Mount (Windows)', "HIGH", "insider_threat", 0.82, "TA0010/T1052.001", "username hostname message",
      "message", r"(?i)(EventID.*6416|A\s+new\s+external\s+device\s+was\s+recognized|removable\s+storage\s+device|USB.*STOR|USBSTOR|setupapi.*USB\\|DriveLetter.*[E-Z]:\\.*USB|volume.*mounted.*removable)"),
    R("INSD-006", 'Email / Cloud Storage Exfiltration Prep', "HIGH", "insider_threat", 0.75, "TA0010/T1567.002", "source_ip username http_uri_decoded http_bytes",
      "http_uri_decoded", r"(?i)(dropbox\.com\/upload|drive\.google\.com\/upload|wetransfer\.com\/upload|onedrive\.live\.com\/upload|send\.firefox\.com|mega\.nz\/upload|box\.com\/upload|paste\.ee|pastebin\.com\/add|transfer\.sh\/upload)"),
    T("INSD-007", 'Account Enumeration by Authenticated User', "MEDIUM", "insider_threat", 0.7, "TA0007/T1087", "username source_ip http_uri", "username", 20, 300, {'http_status_in': [200]}, 'http_uri'),
    S("INSD-008", 'Impossible Travel Login', "HIGH", "insider_threat", 0.65, "TA0001/T1078", "username source_ip timestamp", "username", 3600, [{'match_field': 'auth_result', 'value': 'success'}, {'match_field': 'auth_result', 'value': 'success'}]),
    # lateral_movement
    R("LAT-001", 'Pass-the-Hash / Overpass-the-Hash', "CRITICAL", "lateral_movement", 0.85, "TA0008/T1550.002", "source_ip username hostname message",
      "message", r"(?i)(NTLM.*LogonType.*3|LogonType.*3.*NTLM|AuthenticationPackageName.*NTLM.*Workstation|NtLmSsp\s|NTLMSSP|sekurlsa::pth|Invoke-TheHash|CrackMapExec.*-H\s+[a-f0-9]{32})"),
    R("LAT-002", 'RDP Lateral Movement (EventID 4624 Type 10)', "HIGH", "lateral_movement", 0.82, "TA0008/T1021.001", "source_ip username hostname",
      "message", r"(?i)(LogonType.*10|LogonType\s*=\s*10|RemoteInteractive|EventID.*4624.*LogonType.*10|TerminalServices|RDP.*connection\s+from)"),
    R("LAT-003", 'SMB Lateral File Transfer', "HIGH", "lateral_movement", 0.8, "TA0008/T1021.002", "source_ip hostname message username",
      "message", r"(?i)(\\\\[^\\]+\\(C\$|ADMIN\$|IPC\$)|net\s+use\s+\\\\|copy\s+.*\\\\\S+\\(C\$|ADMIN\$)|PsExec.*\\\\|wmic.*\/node:|impacket.*smbclient|smbclient.*put\s)"),
    R("LAT-004", 'SSH Pivoting / Tunneling', "HIGH", "lateral_movement", 0.82, "TA0008/T1021.004", "source_ip username message",
      "message", r"(?i)(ssh\s+.*-[LRD]\s+\d+:|ssh\s+.*-w\s+\d+|ssh.*ProxyJump|ssh.*ProxyCommand|Accepted.*port\s+(8[0-9]{3}|9[0-9]{3}|[1-9][0-9]{4})\s|forwarding\s+(local|remote)\s+port|-D\s+\d{4,5}.*socks)"),
    R("LAT-005", 'Kerberoasting â€” TGS Ticket Spike (EventID 4769)', "CRITICAL", "lateral_movement", 0.88, "TA0006/T1558.003", "source_ip username hostname message",
      "message", r"(?i)(EventID.*4769|Kerberos.*ServiceTicket.*RC4|TicketEncryptionType.*0x17|4769.*0x17|ServiceName.*\$.*TicketEncryptionType|GetST\.py|Rubeus.*kerberoast|impacket.*GetUserSPNs)"),
    R("LAT-006", 'DCSync Attack', "CRITICAL", "lateral_movement", 0.92, "TA0006/T1003.006", "source_ip username hostname message",
      "message", r"(?i)(lsadump::dcsync|1131f6aa-9c07-11d1-f79f-00c04fc2dcd2|1131f6ad-9c07-11d1-f79f-00c04fc2dcd2|DS-Replication-Get-Changes-All|drsuapi.*DsGetNCChanges|secretsdump.*\.py|impacket.*secretsdump)"),
    R("LAT-007", 'WinRM / PSRemoting Lateral Movement', "MEDIUM", "lateral_movement", 0.75, "TA0008/T1021.006", "source_ip username hostname message",
      "message", r"(?i)(WSMan|WinRM|PSRemoting|New-PSSession|Enter-PSSession|Invoke-Command.*ComputerName|EventID.*4688.*wsmprovhost|winrm.*service|port\s+5985|port\s+5986|winrs\s+-r:)"),
    R("LAT-008", 'LLMNR / NBT-NS Poisoning Tool', "CRITICAL", "lateral_movement", 0.9, "TA0006/T1557.001", "source_ip hostname message",
      "message", r"(?i)(Responder\s+v|NBT-NS\s+Poisoning|LLMNR\s+Poisoning|Inveigh\s+v|Invoke-Inveigh|\[NBT-NS\].*Poisoned|\[LLMNR\].*Poisoned|NTLMv[12]\s+captured|SMB\s+NTLMv2|poisoning\s+started)"),
    # lolbin
    R("LOL-001", 'CertUtil Malicious File Download', "HIGH", "lolbin", 0.92, "TA0011/T1105", "hostname username message",
      "message", r"(?i)(certutil(\.exe)?\s+.*((-|\/)urlcache|(-|\/)split|(-|\/)f|(-|\/)decode)|certutil.*https?://|certutil.*ftp://)"),
    R("LOL-002", 'MSHTA Remote Script Execution', "CRITICAL", "lolbin", 0.93, "TA0002/T1218.005", "hostname username message",
      "message", r"(?i)(mshta(\.exe)?\s+.*(https?://|ftp://|\\\\)|mshta.*vbscript:|mshta.*javascript:|mshta.*\.hta)"),
    R("LOL-003", 'Regsvr32 Squiblydoo Bypass', "CRITICAL", "lolbin", 0.93, "TA0002/T1218.010", "hostname username message",
      "message", r"(?i)(regsvr32(\.exe)?\s+.*(\/s\s+\/n\s+\/i:|\/i:https?://|\/i:\\\\|\s+scrobj\.dll)|regsvr32.*\.sct)"),
    R("LOL-004", 'BITSAdmin Malicious Transfer', "HIGH", "lolbin", 0.9, "TA0011/T1197", "hostname username message",
      "message", r"(?i)(bitsadmin(\.exe)?\s+.*(\/transfer|\/create|\/addfile|\/resume)|bitsadmin.*https?://|bitsadmin.*/priority\s+high)"),
    R("LOL-005", 'WScript / CScript Remote Execution', "HIGH", "lolbin", 0.87, "TA0002/T1059.005", "hostname username message",
      "message", r"(?i)((wscript|cscript)(\.exe)?\s+.*(\\\\|https?://|ftp://|%temp%|%appdata%|/tmp/|C:\\Users\\.*\\AppData)|(wscript|cscript).*\.vbs.*http|(wscript|cscript).*\.js.*http)"),
    R("LOL-006", 'Rundll32 Malicious DLL Execution', "HIGH", "lolbin", 0.87, "TA0005/T1218.011", "hostname username message",
      "message", r"(?i)(rundll32(\\.exe)?\\s+.*(javascript:|\\\\\\\\|https?://|%temp%|%appdata%|C:\\\\Users\\\\.*AppData\\\\Local\\\\Temp|advpack\\.dll.*LaunchINFSection|ieadvpack\\.dll.*LaunchINFSection|setupapi\\.dll.*InstallHinfSection|shell32\\.dll.*Control_RunDLL)|rundll32.*\\.dll,DllInstall)"),
    R("LOL-007", 'MSBuild / CSC Inline Code Execution', "HIGH", "lolbin", 0.88, "TA0002/T1127.001", "hostname username message",
      "message", r"(?i)(msbuild(\\.exe)?\\s+.*\\.xml|msbuild(\\.exe)?\\s+.*\\.csproj|msbuild.*\\\\temp\\\\|msbuild.*inline.*task|csc(\\.exe)?\\s+.*\\/out:.*\\\\temp|msbuild.*TaskFactory.*RoslynCodeTaskFactory|MSBuildShell|msbuild.*exec.*download)"),
    R("LOL-008", 'InstallUtil Bypass', "HIGH", "lolbin", 0.9, "TA0002/T1218.004", "hostname username message",
      "message", r"(?i)(installutil(\\.exe)?\\s+.*(\\/logfile=|\\/logtoconsole=false|\\/u\\s+|\\/uninstall\\s+)|InstallUtil.*payload|installutil.*(temp|appdata|programdata))"),
    R("LOL-009", 'WMIC Remote Command Execution', "HIGH", "lolbin", 0.87, "TA0008/T1021", "hostname username message",
      "message", r"(?i)(wmic(\\.exe)?\\s+.*\\/node:\\s*[0-9]|wmic.*\\/node:.*process\\s+call\\s+create|wmic.*\\/node:.*os\\s+get|wmic.*xsl.*http|wmic.*process.*call.*create.*cmd|wmic.*process.*call.*create.*powershell)"),
    # malware
    R("MAL-001", 'Base64 Encoded Payload in Request', "HIGH", "malware", 0.78, "TA0005/T1027", "http_uri_decoded source_ip http_user_agent",
      "http_uri_decoded", r"(?i)((?:[A-Za-z0-9+/]{4}){25,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?|base64[,;]|powershell.*-enc[odedcommand\s]+[A-Za-z0-9+/]{20,}|cmd.*\/c.*[A-Za-z0-9+/]{30,})"),
    R("MAL-002", 'Reverse Shell Indicator', "CRITICAL", "malware", 0.91, "TA0011/T1059", "source_ip message hostname",
      "message", r"""(?i)(bash\s+-i\s+>&\s+/dev/tcp/|nc\s+-e\s+/bin/(sh|bash)|ncat\s+.*--exec|socat\s+.*exec:|python[23]?\s+-c\s+['"]import\s+socket|perl\s+-e\s+['"]use\s+Socket|ruby\s+-rsocket|0<&\d+-\s+exec\s+\d+<>|/dev/tcp/\d{1,3}\.\d{1,3}|mknod.*\/dev\/tcp)"""),
    R("MAL-003", 'Cryptominer Activity', "HIGH", "malware", 0.87, "TA0040/T1496", "source_ip message hostname",
      "message", r"(?i)(stratum\+tcp://|stratum\+ssl://|\.pool\.minergate\.com|xmrig|monero|cryptonight|\.minexmr\.com|\.nanopool\.org|\.supportxmr\.com|c3pool\.com|hashrate|mining\s+pool|/bin/xmrig\s|xmr-stak)"),
    R("MAL-004", 'Malicious PowerShell Execution', "CRITICAL", "malware", 0.88, "TA0002/T1059.001", "hostname username message",
      "message", r"(?i)(powershell.*-enc[odedcommand\s]|powershell.*-nop[rofile\s].*-w[indowstyle\s]\s*h[idden\s]|powershell.*bypass.*iex|iex\s*\(|invoke-expression|invoke-webrequest.*downloadstring|\[system\.convert\]::frombase64string|new-object\s+net\.webclient|\(new-object\s+system\.net\.webclient\)\.downloadstring|start-process\s+powershell.*hidden)"),
    R("MAL-005", 'Certutil Malicious File Download (LOLBin)', "HIGH", "malware", 0.9, "TA0011/T1105", "hostname username message",
      "message", r"(?i)(certutil.*-urlcache|certutil.*-split|certutil.*-f\s+https?://|certutil.*-decode\s|certutil.*-encode\s)"),
    R("MAL-006", 'MSHTA / Regsvr32 Remote Payload', "CRITICAL", "malware", 0.88, "TA0005/T1218", "hostname username message",
      "message", r"(?i)(mshta\s+https?://|mshta\s+.*\.hta|regsvr32.*\/s.*\/n.*\/u.*https?://|regsvr32.*scrobj\.dll|rundll32.*javascript:|wscript\s+https?://|cscript\s+https?://)"),
    R("MAL-007", 'Suspicious Process Spawned by Web Server', "CRITICAL", "malware", 0.92, "TA0002/T1059", "hostname message process_name",
      "message", r"(?i)((apache2?|httpd|nginx|w3wp|tomcat|java)\s.*spawned|ParentImage.*\\(apache|httpd|nginx|w3wp|tomcat).*ChildImage.*(cmd|powershell|sh|bash|wscript|cscript)|w3wp\.exe.*cmd\.exe|httpd.*\/bin\/(sh|bash))"),
    R("MAL-008", 'LSASS Memory Access (Credential Dumping)', "CRITICAL", "malware", 0.87, "TA0006/T1003.001", "hostname username message process_name",
      "message", r"(?i)(lsass\.exe.*access|TargetImage.*lsass\.exe|procdump.*lsass|sekurlsa::|kerberos::list|lsadump::|Dumping\s+lsass|MiniDumpWriteDump.*lsass|OpenProcess.*lsass)"),
    R("MAL-009", 'Shadow Copy Deletion (Ransomware Prep)', "CRITICAL", "malware", 0.95, "TA0040/T1490", "hostname username message",
      "message", r"(?i)(vssadmin\s+(delete|resize)\s+shadows|wmic\s+shadowcopy\s+delete|Get-WmiObject\s+Win32_Shadowcopy.*delete|bcdedit.*recoveryenabled.*no|bcdedit.*bootstatuspolicy.*ignoreallfailures|wbadmin\s+delete\s+catalog)"),
    R("MAL-010", 'Suspicious wget / curl Download from Process Log', "HIGH", "malware", 0.8, "TA0011/T1105", "hostname source_ip message",
      "message", r"(?i)((wget|curl)\s+https?://[^\s]+\s+-[oO]\s+/(tmp|dev/shm|var/tmp)|curl.*-s.*\|\s*(bash|sh)|wget.*-q.*-O.*\|\s*(bash|sh)|wget.*-q\s+-O\s+-\s+https?://.*\|\s*bash|curl.*silent.*https?://.*\|\s*(bash|sh))"),
    # network_attack
    R("NET-001", 'DNS Rebinding Attack', "HIGH", "network_attack", 0.8, "TA0008/T1557", "source_ip message",
      "message", r"(?i)(TTL\s*:\s*[0-9]\b|TTL=[0-9]\b|dns.*ttl.*\b[0-9]\b.*(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|127\.)|ANSWER.*\b[0-9]\b.*TTL.*(10\.|192\.168\.|172\.)|dns\s+rebind|rebinding\s+detected)"),
    R("NET-002", 'ICMP Tunneling / Covert Channel', "HIGH", "network_attack", 0.78, "TA0011/T1095", "source_ip dest_ip message",
      "message", r"(?i)(ICMP.*length\s*[2-9][0-9]{2,}|icmp.*payload.*[89][0-9][0-9]|ICMP.*type\s*8.*data\s*length\s*[1-9][0-9]{2,}|ping.*size\s*[1-9][0-9]{3,}|icmpsh|icmp\s*tunnel|ptunnel|icmptunnel)"),
    R("NET-003", 'SMBv1 EternalBlue / MS17-010 Exploit Pattern', "CRITICAL", "network_attack", 0.88, "TA0008/T1210", "source_ip dest_ip message",
      "message", r"(?i)(NT\s+LM\s+0\.12|SMB1|SMBv1|dialect.*NT\s+LM\s+0\.12|MS17-010|EternalBlue|DOUBLEPULSAR|Trans2\s+SESSION_SETUP|SMB.*\\\*SMBSERVER|port\s+445.*EXPLOIT|smb.*overflow)"),
    R("NET-004", 'SSL / TLS Certificate Anomaly', "MEDIUM", "network_attack", 0.7, "TA0011/T1573", "source_ip dest_ip message",
      "message", r"(?i)(self.signed\s+certificate|certificate.*verify\s+failed|SSL_ERROR_BAD_CERT_DOMAIN|certificate.*expired|certificate.*issued\s+by.*Unknown|CN=.*\.(bit|onion|tk|ml|ga|cf)\b|SubjectCN.*[a-z0-9]{20,}\.(com|net|org)|issuer.*Let.s\s+Encrypt.*validity.*[1-9]\s+day)"),
    R("NET-005", 'ARP Spoofing / Cache Poisoning', "HIGH", "network_attack", 0.82, "TA0008/T1557.002", "source_ip dest_ip message",
      "message", r"(?i)(ARP.*duplicate|duplicate\s+IP|possible\s+ARP\s+(spoofing|poisoning|flood)|received\s+arp\s+from.*different\s+MAC|gratuitous\s+ARP.*conflict|IP.*already\s+in\s+use|arp\s+cache\s+poisoning|arpspoof|bettercap.*arp)"),
    R("NET-006", 'VLAN Hopping Attempt', "HIGH", "network_attack", 0.78, "TA0008/T1599.001", "source_ip message",
      "message", r"(?i)(vlan\s+hop|double.tag|802\.1[Qq].*802\.1[Qq]|DTP\s+negotiation|dynamic\s+trunking|native\s+vlan.*mismatch|switch.*trunk.*negotiating|yersinia.*vlan|scapy.*dot1q.*dot1q)"),
    R("NET-007", 'Tor / Anonymous Network Exit Node', "MEDIUM", "network_attack", 0.85, "TA0043/T1090.003", "source_ip message",
      "message", r"(?i)(tor\s+exit\s+node|\.onion\b|torproject\.org|torbrowser|Tor.*circuit|exit\s+policy|i2p.*router|i2p.*tunnel|freenet\.org|known\s+(proxy|vpn|anonymizer)\s+IP|anonmgr|tor2web)"),
    # persistence
    R("PERS-001", 'Suspicious Script Extension Upload', "CRITICAL", "persistence", 0.87, "TA0003/T1505.003", "http_uri_decoded source_ip http_method",
      "http_uri_decoded", r"(?i)(upload|files|media|static|assets|images|docs|temp|tmp|backup).*\.(php[3-8]?|phtml|php\.jpg|asp|aspx|asmx|ashx|jsp|jspx|cfm|cfml|pl|py|rb|cgi|shtml)$", {'http_method': 'POST'}),
    R("PERS-002", 'Windows Scheduled Task Created (4698)', "HIGH", "persistence", 0.8, "TA0003/T1053.005", "username hostname",
      "event_id", r"^4698$"),
    R("PERS-003", 'New Windows User Account (4720)', "HIGH", "persistence", 0.85, "TA0003/T1136.001", "username hostname",
      "event_id", r"^4720$"),
    R("PERS-004", 'WMI Event Subscription (Sysmon 19/20/21)', "CRITICAL", "persistence", 0.9, "TA0003/T1546.003", "hostname username",
      "event_id", r"^(19|20|21)$"),
    R("PERS-005", 'WMI Consumer Type â€” Script/CommandLine Execution', "CRITICAL", "persistence", 0.93, "TA0003/T1546.003", "hostname message",
      "message", r"(?i)(ActiveScriptEventConsumer|CommandLineEventConsumer|root\\subscription|__EventFilter|__EventConsumer|__FilterToConsumerBinding|WQL.*SELECT.*__InstanceCreationEvent)"),
    R("PERS-006", 'Linux Cron Backdoor', "HIGH", "persistence", 0.85, "TA0003/T1053.003", "hostname username message",
      "message", r"(?i)(crontab|/etc/cron\.(d|daily|hourly|weekly|monthly)|/var/spool/cron).*(wget|curl|bash|sh|python|perl|/tmp/|/dev/shm/|/var/tmp/)"),
    R("PERS-007", 'Windows Registry Run Key Modification', "HIGH", "persistence", 0.82, "TA0003/T1547.001", "hostname username message",
      "message", r"(?i)(HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run|HKCU\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run|CurrentVersion\\RunOnce|CurrentVersion\\RunServices|reg\s+add.*\\Run|New-ItemProperty.*Run)"),
    # privilege_escalation
    R("PRIV-001", 'Windows Token Impersonation / Theft (T1134)', "CRITICAL", "privilege_escalation", 0.88, "TA0004/T1134", "hostname username message process_name",
      "message", r"(?i)(SeImpersonatePrivilege|SeAssignPrimaryTokenPrivilege|SeCreateTokenPrivilege|SeTcbPrivilege|ImpersonateNamedPipeClient|DuplicateTokenEx|CreateProcessWithTokenW|SetThreadToken|JuicyPotato|PrintSpoofer|RoguePotato|SweetPotato|RottenPotato|token\s+impersonat|privilege\s+escalat.*token)"),
    R("PRIV-002", 'UAC Bypass Technique', "CRITICAL", "privilege_escalation", 0.9, "TA0004/T1548.002", "hostname username message",
      "message", r"(?i)(fodhelper\.exe.*\\\S+\.exe|eventvwr\.exe.*\\\S+\.exe|sdclt\.exe.*\/kickoffelev|cmstp\.exe.*\/s|HKCU\\Software\\Classes\\ms-settings|HKCU\\Software\\Classes\\mscfile|HKCU.*Shell\\Open\\command.*cmd|UACMe|bypassuac|uacbypass|Bypass.*UAC.*registry|DiskCleanup.*elevation)"),
    S("PRIV-003", 'Sudo Privilege Escalation (Linux)', "CRITICAL", "privilege_escalation", 0.85, "TA0004/T1548.003", "source_ip username hostname message", "source_ip", 120, [{'match_field': 'message', 'value_contains': 'sudo -l'}, {'match_field': 'message', 'value_contains': 'sudo'}]),
    R("PRIV-004", 'SUID / SGID Binary Abuse (GTFOBins)', "HIGH", "privilege_escalation", 0.82, "TA0004/T1548.001", "source_ip username hostname message",
      "message", r"""(?i)(find\s+.*-exec\s+\/bin\/(sh|bash)|\/usr\/bin\/find.*-exec\s+sh|python[23]?\s+-c\s+['"]import\s+os.*setuid|perl\s+-e\s+['"]exec\s*['"]\/bin\/sh|vim\s+.*-c\s+['"]!\/bin\/bash|nmap\s+--interactive|env\s+\/bin\/sh|env\s+\/bin\/bash|(bash|sh)\s+-p\s+-i|SUID.*escalat|\/bin\/bash\s+-p)"""),
    R("PRIV-005", 'Kernel Exploit Attempt', "CRITICAL", "privilege_escalation", 0.88, "TA0004/T1068", "hostname username message",
      "message", r"(?i)(dirtypipe|dirty_pipe|CVE-2022-0847|dirtycow|dirty_cow|CVE-2016-5195|pwnkit|CVE-2021-4034|pkexec\s+--|overlayfs.*exploit|CVE-2021-3493|CVE-2023-4911|looney_tunables|CVE-2022-2586|CVE-2023-32629|raptor_udf|exploit.*kernel.*root)"),
    R("PRIV-006", 'Named Pipe Impersonation', "HIGH", "privilege_escalation", 0.82, "TA0004/T1134.001", "hostname username message process_name",
      "message", r"(?i)(CreateNamedPipe.*\\pipe\\|ImpersonateNamedPipe|ConnectNamedPipe|Sysmon.*EventID.*17|Sysmon.*EventID.*18|pipe.*created.*SYSTEM|named\s+pipe.*impersonat|getsystem.*named.pipe|meterpreter.*getsystem)"),
    R("PRIV-007", 'Windows Service Binary Hijacking', "HIGH", "privilege_escalation", 0.83, "TA0004/T1574.010", "hostname username message",
      "message", r"(?i)(EventID.*7045.*%TEMP%|EventID.*7045.*%APPDATA%|EventID.*7045.*C:\\\\Users|sc\s+create.*binPath.*%|unquoted.*service\s+path|service.*binary.*writable|icacls.*service.*Everyone.*F|accesschk.*service.*write)"),
    R("PRIV-008", 'DLL Hijacking / Search Order Abuse', "HIGH", "privilege_escalation", 0.8, "TA0004/T1574.001", "hostname username message process_name",
      "message", r"(?i)(Sysmon.*EventID.*7.*Unsigned|ImageLoaded.*C:\\\\Users.*\.dll|ImageLoaded.*%TEMP%.*\.dll|DLL.*loaded.*from.*writable|unsigned.*DLL.*system32|dll.*hijack|dll.*search.*order|phantom\s+dll|ImageLoaded.*AppData.*\.dll)"),
    R("PRIV-009", 'Polkit / PwnKit Local Privilege Escalation', "CRITICAL", "privilege_escalation", 0.85, "TA0004/T1068", "hostname username message",
      "message", r"(?i)(pkexec\s*$|pkexec\s+--disable-internal-agent|polkit.*exploit|CVE-2021-4034|pkexec.*argc.*0|polkit\s+authentication\s+failed.*root|pwnkit|pkexec.*environment.*GCONV_PATH)"),
    # recon
    T("RECON-001", 'Port Scan Detected', "MEDIUM", "recon", 0.85, "TA0043/T1595.001", "source_ip", "source_ip", 15, 30, {}, 'dest_port'),
    T("RECON-002", 'Web Directory Enumeration', "MEDIUM", "recon", 0.8, "TA0043/T1595.003", "source_ip http_user_agent", "source_ip", 20, 30, {'http_status_in': [404]}, None),
    R("RECON-003", 'API Endpoint Discovery', "LOW", "recon", 0.72, "TA0043/T1595", "source_ip http_uri",
      "http_uri_decoded", r"(?i)^/(api|v[0-9]+|rest|graphql|swagger|openapi|actuator|metrics|health|debug|admin|management|console)(/|$)"),
    R("RECON-004", 'Cloud / S3 Bucket Enumeration', "MEDIUM", "recon", 0.75, "TA0043/T1596", "source_ip http_uri",
      "http_uri_decoded", r"(?i)(\.s3\.amazonaws\.com|s3-website|\.blob\.core\.windows\.net|\.storage\.googleapis\.com|/\.env|/config\.json|/secrets\.json|/\.git/config|/\.svn/entries|/WEB-INF/web\.xml)"),
    R("RECON-005", 'Host Fingerprinting via HTTP Methods', "LOW", "recon", 0.68, "TA0043/T1595", "source_ip http_method http_uri",
      "http_method", r"^(OPTIONS|TRACE|TRACK|PROPFIND|PROPPATCH|MKCOL|COPY|MOVE|LOCK|UNLOCK|CONNECT|DEBUG)$"),
    R("RECON-006", 'Shodan / Mass Internet Scanner', "LOW", "recon", 0.8, "TA0043/T1596", "source_ip http_user_agent http_uri",
      "http_user_agent", r"(?i)(Shodan|Censys|ZoomEye|Masscan|zgrab|InternetMeasurement|ivre\b|shadow-server|ShadowServer|Expanse\s+indexes|binaryedge|netcraft\s+survey|netsys\.com)"),
    T("RECON-007", 'Subdomain / DNS Enumeration', "MEDIUM", "recon", 0.78, "TA0043/T1596.001", "source_ip", "source_ip", 50, 60, {}, 'dest_ip'),
    R("RECON-008", 'SSL Certificate / CT Log Enumeration', "LOW", "recon", 0.68, "TA0043/T1596.003", "source_ip http_uri_decoded",
      "http_uri_decoded", r"(?i)(crt\.sh\/\?q=|crt\.sh\/\?identity=|censys\.io\/certificates|certspotter\.com\/api|transparencyreport\.google\.com\/https\/ct|sslmate\.com\/certspotter)"),
    # supply_chain
    R("SC-001", 'Dependency Confusion / Namespace Squatting Install', "HIGH", "supply_chain", 0.78, "TA0001/T1195.001", "hostname message process_name",
      "message", r"(?i)(npm\s+install.*--registry\s+https?://(?!registry\.npmjs\.org)|pip\s+install.*-i\s+https?://(?!pypi\.org)|pip\s+install.*--index-url\s+https?://(?!pypi\.org)|gem\s+install.*--source\s+https?://(?!rubygems\.org)|package.*installed.*from.*internal.*public|dependency.*confusion|Downloading\s+https?://(?!pypi\.org|files\.pythonhosted\.org|registry\.npmjs\.org|dl\.google\.com)[^\s]+\.(whl|tar\.gz|tgz|zip))"),
    R("SC-002", 'Malicious npm / PyPI Package Execution Pattern', "CRITICAL", "supply_chain", 0.87, "TA0002/T1195.002", "hostname message process_name",
      "message", r"(?i)((node|python[23]?|pip)\s+.*\|\s*(bash|sh|curl|wget)|npm\s+install.*&&\s*(bash|sh|curl|wget|nc)|postinstall.*curl.*\|\s*bash|setup\.py.*install.*exec\s*\(|node_modules\/\.bin\/.*\s+(curl|wget|nc)\s+|site-packages\/.*subprocess.*shell.*True|package.*install.*spawned.*(cmd|bash|sh|powershell))"),
    R("SC-003", 'CI/CD Pipeline Secret Exfiltration', "CRITICAL", "supply_chain", 0.85, "TA0006/T1552.001", "hostname message source_ip",
      "message", r"(?i)((GITHUB_TOKEN|CI_JOB_TOKEN|CIRCLE_TOKEN|TRAVIS.*TOKEN|AWS_SECRET|DOCKER_PASSWORD|NPM_TOKEN|PYPI_TOKEN|DEPLOYMENT_KEY|SSH_PRIVATE_KEY)\s*=|env\s*\|\s*(curl|wget|nc)\s+|printenv.*\|\s*(curl|wget)|secrets\.*\|\s*(curl|wget|base64)|\.github\/workflows.*curl.*GITHUB_TOKEN|pipeline.*secret.*exfil)"),
    R("SC-004", 'Typosquatted Package Name Pattern', "HIGH", "supply_chain", 0.72, "TA0001/T1195.001", "hostname message",
      "message", r"(?i)(Collecting\s+(requets|reqeusts|requsts|urllib4|urlib3|boto|b0to3|botto3|djang0|flaskk|fastap1|cryptograpy|pycrypto2|openssl2|numpy2|nump1|panads|pnadas|setup-tools|setuptool|pip-tools2|requests-html2)(\s|==|>|$)|installing\s+(requets|djang0|flaskk|urllib4|boto(?!3)))"),
    R("SC-005", 'Git Repository Credential Leak', "CRITICAL", "supply_chain", 0.92, "TA0006/T1552.001", "source_ip http_uri_decoded",
      "http_uri_decoded", r"(?i)(\/\.git\/(config|credentials|HEAD|FETCH_HEAD|packed-refs)|\/\.git-credentials|\/\.netrc|\/\.hg\/hgrc|\/\.svn\/auth\/|\/\.bzr\/branch\/branch\.conf|git\s+config\s+--global.*credential)"),
    R("SC-006", 'GitHub Actions / Workflow Injection', "HIGH", "supply_chain", 0.8, "TA0002/T1059", "hostname message",
      "message", r"(?i)(\$\{\{\s*(github\.event\.(issue|pull_request|comment)\.(body|title)|env\.|secrets\.)|\$\{\{.*run:\s*|actions\/checkout.*ref.*\$\{\{|on:\s*pull_request_target.*uses:|pwn_request|workflow.*injection)"),
    R("SC-007", 'Docker Image from Untrusted / Unofficial Source', "MEDIUM", "supply_chain", 0.75, "TA0001/T1195.003", "hostname message",
      "message", r"(?i)(docker\s+pull\s+(?!docker\.io\/library\/|gcr\.io\/|public\.ecr\.aws\/|mcr\.microsoft\.com\/|registry\.k8s\.io\/)[^\s]+\/[^\s]+|Pulling\s+from\s+[^\s]+\/xmrig|Pulling\s+from\s+[^\s]+\/minerd|image.*pulled.*from.*registry(?!\.k8s\.io|\.microsoft\.com|\.docker\.com|gcr\.io|ecr\.aws))"),
    R("SC-008", 'Outbound Connection During Package Install', "HIGH", "supply_chain", 0.8, "TA0010/T1041", "source_ip hostname message",
      "message", r"(?i)((npm\s+install|pip\s+install|gem\s+install|go\s+get).*(established|connected|CONNECT)\s+[0-9]{1,3}\.[0-9]{1,3}|setup\.py.*urllib.*open|postinstall.*curl\s+https?://[^\s]+\?|install.*beacon|install.*callback\s+https?://)"),
    # web_attack
    R("WEB-001", 'SQL Injection Attempt', "HIGH", "web_attack", 0.85, "TA0001/T1190", "http_uri_decoded source_ip http_user_agent",
      "http_uri_decoded", r"(?i)('\s*(or|and)\s*'?\d|\bunion\b.{0,30}\bselect\b|--\s*$|;\s*(drop|truncate|delete|insert|update)\s+\b|\bexec\s*\(|xp_cmdshell|0x[0-9a-f]{4,}|char\s*\(\s*\d+|\bwaitfor\s+delay\b|\bsleep\s*\(\s*\d|\bload_file\s*\(|\binto\s+outfile\b|\binformation_schema\b|\bgroup_concat\s*\()"),
    R("WEB-002", 'Cross-Site Scripting (XSS)', "MEDIUM", "web_attack", 0.8, "TA0002/T1059.007", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)(<\s*script[\s>]|javascript\s*:|on(error|load|click|mouse\w+|key\w+|focus|blur|submit)\s*=|<\s*(img|svg|body|input|iframe|embed|object|video|audio)[^>]+\s+on\w+\s*=|alert\s*\(|document\s*\.\s*(cookie|location|write)|\beval\s*\(|String\s*\.\s*fromCharCode|expression\s*\()"),
    R("WEB-003", 'Directory / Path Traversal', "HIGH", "web_attack", 0.9, "TA0007/T1083", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)(\.\./|\.\.\\|%2e%2e%2f|%2e%2e/|\.\.%2f|%252e%252e|\.\.%5c|/etc/(passwd|shadow|hosts|crontab|sudoers)|/proc/self|/root/\.ssh|/home/\w+/\.ssh|\\windows\\system32|\.\.[\\/]{1,3}(etc|proc|windows|boot|var|usr))"),
    R("WEB-004", 'Local / Remote File Inclusion', "CRITICAL", "web_attack", 0.85, "TA0001/T1190", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)((file|php|zip|data|expect|input|glob|phar)\s*://|=https?://[^/]+/|=ftp://|php://filter|php://input|/var/log/(nginx|apache2?|access|error)|/proc/self/(environ|fd))"),
    R("WEB-005", 'OS Command Injection', "CRITICAL", "web_attack", 0.88, "TA0002/T1059", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)([;&|`]\s*(ls|cat|id|whoami|uname|wget|curl|bash|sh|python[23]?|perl|ruby|nc|ncat|nmap|ping)\b|\$\([^)]{0,80}\)|`[^`]{0,80}`|\|\s*(bash|sh|cmd)|>\s*/dev/null|/bin/(sh|bash|dash)|cmd\.exe|powershell|&&\s*(wget|curl|bash))"),
    # recon
    R("WEB-006", 'Known Attack Tool User-Agent', "MEDIUM", "recon", 0.95, "TA0043/T1595", "http_user_agent source_ip",
      "http_user_agent", r"(?i)(sqlmap|nikto|nessus|openvas|masscan|nmap|zgrab|nuclei|dirbuster|gobuster|feroxbuster|ffuf|hydra|medusa|burpsuite|metasploit|python-requests/[12]\.|go-http-client/1\.|curl/[0-6]\.|libwww-perl|w3af|acunetix|appscan|arachni|wapiti|skipfish|vega\b|owasp\s*zap)"),
    # web_attack
    R("WEB-007", 'Server-Side Request Forgery (SSRF)', "HIGH", "web_attack", 0.82, "TA0007/T1526", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)(=https?://(127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|localhost|0\.0\.0\.0)|=https?://\[::1\]|metadata\.google\.internal|169\.254\.169\.254|instance-data|=file://|=gopher://|=dict://|=sftp://)"),
    # persistence
    R("WEB-008", 'Webshell Access Pattern', "CRITICAL", "persistence", 0.82, "TA0003/T1505.003", "http_uri_decoded source_ip http_method",
      "http_uri_decoded", r"(?i)((cmd|exec|command|shell|run|system|passthru|eval)\s*=|\.php\?(cmd|c|execute|run|act)=|/(shell|cmd|c99|r57|b374k|wso|antsword|cknife|godzilla|behinder)\.(php|asp|aspx|jsp)|/uploads/.*\.(php[3-8]?|phtml|asp|aspx|jsp))"),
    # web_attack
    R("WEB-009", 'Server-Side Template Injection (SSTI)', "CRITICAL", "web_attack", 0.87, "TA0001/T1190", "http_uri_decoded source_ip http_status",
      "http_uri_decoded", r"(?i)(\$\{7\*7\}|\{\{7\*7\}\}|\$\{.*\}|\{\{.*\}\}|<%=.*%>|<#.*#>|\#\{.*\}|\{\{config\}\}|\{\{request\}\}|\{\{''\.\_\_class\_\_\}\}|\{%.*import.*%\}|\{\{.*\_\_import\_\_.*\}\}|\#set\s*\(|\$\{.*getRuntime.*\})"),
    T("WEB-010", 'IDOR / BOLA Object Enumeration', "HIGH", "web_attack", 0.78, "TA0007/T1083", "source_ip http_uri", "source_ip", 10, 30, {'http_status_in': [200, 404]}, None),
    R("WEB-011", 'XML External Entity (XXE) Injection', "HIGH", "web_attack", 0.88, "TA0001/T1190", "http_uri_decoded source_ip",
      "http_uri_decoded", r'(?i)(<!DOCTYPE|<!ENTITY|SYSTEM\s+"|PUBLIC\s+"|%xxe;|&xxe;|file:///etc|<!ENTITY\s+\w+\s+SYSTEM)'),
    R("WEB-012", 'HTTP Request Smuggling Indicator', "HIGH", "web_attack", 0.72, "TA0001/T1190", "source_ip message",
      "message", r"(?i)(Transfer-Encoding:\s*xchunked|transfer-encoding:\s*(chunked|identity)\s.*content-length:|content-length:\s*\d+\s.*transfer-encoding:)"),
    R("WEB-013", 'Prototype Pollution', "HIGH", "web_attack", 0.82, "TA0001/T1190", "http_uri_decoded source_ip",
      "http_uri_decoded", r"(?i)(__proto__|constructor\[prototype\]|constructor\.prototype|\[__proto__\]|%5B__proto__%5D|__proto__\[|constructor%5Bprototype%5D)"),
]

TACTICS = {
    "AML.TA0000": "ML Attack Staging",
    "TA0001": "Initial Access",
    "TA0002": "Execution",
    "TA0003": "Persistence",
    "TA0004": "Privilege Escalation",
    "TA0005": "Defense Evasion",
    "TA0006": "Credential Access",
    "TA0007": "Discovery",
    "TA0008": "Lateral Movement",
    "TA0009": "Collection",
    "TA0010": "Exfiltration",
    "TA0011": "Command and Control",
    "TA0040": "Impact",
    "TA0043": "Reconnaissance",
}

TECHNIQUES = {
    "AML.T0037": 'Data from Information Repositories',
    "AML.T0043": 'Craft Adversarial Data',
    "AML.T0051": 'LLM Prompt Injection',
    "T1003.001": 'OS Credential Dumping',
    "T1003.006": 'OS Credential Dumping',
    "T1005": 'Data from Local System',
    "T1018": 'Remote System Discovery',
    "T1021": 'Remote Services',
    "T1021.001": 'Remote Services',
    "T1021.002": 'Remote Services',
    "T1021.004": 'Remote Services',
    "T1021.006": 'Remote Services',
    "T1027": 'Obfuscated Files or Information',
    "T1041": 'Exfiltration Over C2 Channel',
    "T1046": 'Network Service Scanning',
    "T1048": 'Exfiltration Over Alternative Protocol',
    "T1052.001": 'Exfiltration Over Physical Medium',
    "T1053.003": 'Scheduled Task/Job',
    "T1053.005": 'Scheduled Task/Job',
    "T1055": 'Process Injection',
    "T1057": 'Process Discovery',
    "T1059": 'Command and Scripting Interpreter',
    "T1059.001": 'Command and Scripting Interpreter',
    "T1059.005": 'Command and Scripting Interpreter',
    "T1059.007": 'Command and Scripting Interpreter',
    "T1068": 'Exploitation for Privilege Escalation',
    "T1070.001": 'Indicator Removal',
    "T1070.003": 'Indicator Removal',
    "T1070.006": 'Indicator Removal',
    "T1071": 'Application Layer Protocol',
    "T1071.001": 'Application Layer Protocol',
    "T1071.004": 'Application Layer Protocol',
    "T1078": 'Valid Accounts',
    "T1078.003": 'Valid Accounts',
    "T1078.004": 'Valid Accounts',
    "T1082": 'System Information Discovery',
    "T1083": 'File and Directory Discovery',
    "T1087": 'Account Discovery',
    "T1090.003": 'Proxy',
    "T1095": 'Non-Application Layer Protocol',
    "T1105": 'Ingress Tool Transfer',
    "T1110": 'Brute Force',
    "T1110.001": 'Brute Force',
    "T1110.003": 'Brute Force',
    "T1110.004": 'Brute Force',
    "T1127.001": 'Trusted Developer Utilities Proxy Execution',
    "T1134": 'Access Token Manipulation',
    "T1134.001": 'Access Token Manipulation',
    "T1136.001": 'Create Account',
    "T1190": 'Exploit Public-Facing Application',
    "T1195.001": 'Supply Chain Compromise',
    "T1195.002": 'Supply Chain Compromise',
    "T1195.003": 'Supply Chain Compromise',
    "T1197": 'BITS Jobs',
    "T1210": 'Exploitation of Remote Services',
    "T1213": 'Data from Information Repositories',
    "T1218": 'System Binary Proxy Execution',
    "T1218.004": 'System Binary Proxy Execution',
    "T1218.005": 'System Binary Proxy Execution',
    "T1218.010": 'System Binary Proxy Execution',
    "T1218.011": 'System Binary Proxy Execution',
    "T1485": 'Data Destruction',
    "T1486": 'Data Encrypted for Impact',
    "T1489": 'Service Stop',
    "T1490": 'Inhibit System Recovery',
    "T1491.001": 'Defacement',
    "T1496": 'Resource Hijacking',
    "T1498.001": 'Network Denial of Service',
    "T1499": 'Endpoint Denial of Service',
    "T1499.003": 'Endpoint Denial of Service',
    "T1505.003": 'Server Software Component',
    "T1518.001": 'Software Discovery',
    "T1526": 'Cloud Service Discovery',
    "T1528": 'Steal Application Access Token',
    "T1539": 'Steal Web Session Cookie',
    "T1542.003": 'Pre-OS Boot',
    "T1546.003": 'Event Triggered Execution',
    "T1547.001": 'Boot or Logon Autostart Execution',
    "T1548.001": 'Abuse Elevation Control Mechanism',
    "T1548.002": 'Abuse Elevation Control Mechanism',
    "T1548.003": 'Abuse Elevation Control Mechanism',
    "T1550.002": 'Use Alternate Authentication Material',
    "T1550.004": 'Use Alternate Authentication Material',
    "T1552.001": 'Unsecured Credentials',
    "T1552.005": 'Unsecured Credentials',
    "T1557": 'Adversary-in-the-Middle',
    "T1557.001": 'Adversary-in-the-Middle',
    "T1557.002": 'Adversary-in-the-Middle',
    "T1558.003": 'Steal or Forge Kerberos Tickets',
    "T1562.001": 'Impair Defenses',
    "T1562.002": 'Impair Defenses',
    "T1562.006": 'Impair Defenses',
    "T1564.004": 'Hide Artifacts',
    "T1567.002": 'Exfiltration Over Web Service',
    "T1567.003": 'Exfiltration Over Web Service',
    "T1573": 'Encrypted Channel',
    "T1574.001": 'Hijack Execution Flow',
    "T1574.010": 'Hijack Execution Flow',
    "T1595": 'Active Scanning',
    "T1595.001": 'Active Scanning',
    "T1595.002": 'Active Scanning',
    "T1595.003": 'Active Scanning',
    "T1596": 'Search Open Technical Databases',
    "T1596.001": 'Search Open Technical Databases',
    "T1596.003": 'Search Open Technical Databases',
    "T1599.001": 'Network Boundary Bridging',
    "T1609": 'Container Administration Command',
    "T1611": 'Escape to Host',
}
