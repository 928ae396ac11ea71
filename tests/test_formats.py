"""One line of each format, and what must be read from it."""

from datetime import datetime

import pytest

from emberlog.functions import core
from emberlog.sources import formats, probing

CASES = [
    ("apache_combined", '192.168.1.11 - admin [04/Jan/2026:10:00:01 +0200] "POST /login?id=1%27+OR+1%3D1 HTTP/1.1" 200 512 "-" "sqlmap/1.7.8"', {"source_ip": "192.168.1.11", "username": "admin", "http_method": "POST", "http_status": 200, "http_user_agent": "sqlmap/1.7.8", "http_uri_decoded": "/login?id=1' OR 1=1", "timestamp": datetime(2026, 1, 4, 8, 0, 1)}),
    ("auth_log", "Jan  4 10:00:01 web1 sshd[123]: Failed password for root from 192.168.1.11 port 54321 ssh2", {"username": "root", "source_ip": "192.168.1.11", "source_port": 54321, "auth_result": "failure", "severity": "WARNING", "process_name": "sshd", "hostname": "web1"}),
    ("auth_log", "Jan  4 10:00:01 web1 sshd[123]: Accepted password for bob from 10.0.0.1 port 22 ssh2", {"username": "bob", "auth_result": "success", "severity": "INFO"}),
    ("json_lines", '{"timestamp": "2026-01-04T10:00:00Z", "ip": "1.2.3.4", "method": "GET", "uri": "/?q=%3Cscript%3E", "status": 200, "user_agent": "x"}', {"source_ip": "1.2.3.4", "http_uri_decoded": "/?q=<script>", "http_status": 200, "timestamp": datetime(2026, 1, 4, 10)}),
    ("aws_cloudtrail", '{"eventTime": "2026-01-04T10:00:00Z", "eventName": "GetSecretValue", "eventSource": "secretsmanager.amazonaws.com", "sourceIPAddress": "1.2.3.4", "userIdentity": {"userName": "dev-bot"}, "errorCode": "AccessDenied"}', {"username": "dev-bot", "http_method": "GetSecretValue", "auth_result": "failure", "severity": "WARNING"}),
    ("iptables", "Jan 4 10:00:01 fw kernel: DROP IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 PROTO=TCP SPT=99 DPT=22", {"source_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "dest_port": 22, "action": "block"}),
    ("zeek_conn", "1700000000.5\tC1\t1.2.3.4\t99\t5.6.7.8\t443\ttcp\tssl\t1.0\t2000000\t5\tSF", {"source_ip": "1.2.3.4", "dest_port": 443, "action": "allow", "severity": "WARNING"}),
    ("zeek_dns", "1700000000.5\tC1\t1.2.3.4\t99\t8.8.8.8\t53\tudp\t1\t-\tbad.example.com\t1\tC_INTERNET\t1\tA\t3\tNXDOMAIN\tF\tF\tT\tF\t0\t-", {"dns_query": "bad.example.com", "dns_type": "A", "severity": "WARNING"}),
    ("apache_error", "[Sun Jan 04 10:00:01.123 2026] [core:error] [pid 7] [client 1.2.3.4:99] File does not exist", {"source_ip": "1.2.3.4", "source_port": 99, "severity": "ERROR", "timestamp": datetime(2026, 1, 4, 10, 0, 1)}),
    ("nginx_error", "2026/01/04 10:00:01 [error] 7#7: *1 open() failed, client: 1.2.3.4, server: x", {"source_ip": "1.2.3.4", "severity": "ERROR", "process_id": 7}),
    ("squid", "1700000000.123    55 1.2.3.4 TCP_MISS/404 512 GET http://x/a%20b bob DIRECT/1.1.1.1 text/html", {"source_ip": "1.2.3.4", "http_status": 404, "http_uri_decoded": "http://x/a b", "severity": "WARNING", "username": "bob"}),
    ("syslog_rfc5424", '<34>1 2026-01-04T10:00:01Z web1 su 77 ID47 [x@1 user="root" ip="1.2.3.4"] failed', {"hostname": "web1", "process_name": "su", "severity": "CRITICAL", "process_id": 77, "timestamp": datetime(2026, 1, 4, 10, 0, 1)}),
    ("auditd", 'type=USER_LOGIN msg=audit(1700000000.123:55): pid=7 acct="root" addr=1.2.3.4 res=failed', {"event_id": "USER_LOGIN", "username": "root", "source_ip": "1.2.3.4", "auth_result": "failure"}),
    ("journald", '{"__REALTIME_TIMESTAMP": "1700000000000000", "_HOSTNAME": "h", "SYSLOG_IDENTIFIER": "sshd", "PRIORITY": "3", "MESSAGE": "m"}', {"hostname": "h", "process_name": "sshd", "severity": "ERROR"}),
    ("windows_evtx", '<Event><System><EventID>4625</EventID><TimeCreated SystemTime="2026-01-04T10:00:01.000Z"/><Computer>PC1</Computer></System><EventData><Data Name="TargetUserName">bob</Data><Data Name="IpAddress">1.2.3.4</Data></EventData></Event>', {"event_id": "4625", "username": "bob", "source_ip": "1.2.3.4", "auth_result": "failure", "hostname": "PC1"}),
    ("windows_firewall", "2026-01-04 10:00:01 DROP TCP 1.2.3.4 5.6.7.8 99 445 52", {"action": "drop", "source_ip": "1.2.3.4", "dest_port": 445, "severity": "WARNING"}),
    ("suricata_eve", '{"timestamp": "2026-01-04T10:00:01.000000+0000", "event_type": "alert", "src_ip": "1.2.3.4", "dest_port": 80, "alert": {"signature": "ET SCAN", "severity": 1}}', {"source_ip": "1.2.3.4", "dest_port": 80, "rule_name": "ET SCAN", "severity": "HIGH", "timestamp": datetime(2026, 1, 4, 10, 0, 1)}),
    ("snort_fast", "01/04-10:00:01.123456  [**] [1:2003:8] SCAN nmap [**] [Classification: x] [Priority: 2] {TCP} 1.2.3.4:99 -> 5.6.7.8:80", {"source_ip": "1.2.3.4", "dest_port": 80, "severity": "MEDIUM", "rule_name": "SCAN nmap"}),
    ("cisco_asa", "%ASA-4-106023: Deny tcp src outside:1.2.3.4/99 dst inside:5.6.7.8/22 by access-group", {"source_ip": "1.2.3.4", "dest_port": 22, "action": "deny", "severity": "WARNING", "protocol": "tcp"}),
    ("cef", "CEF:0|v|p|1|100|Login failed|8|src=1.2.3.4 dst=5.6.7.8 spt=99 suser=bob msg=two words rt=1700000000000", {"source_ip": "1.2.3.4", "username": "bob", "severity": "HIGH", "event_id": "100"}),
    ("leef", "LEEF:1.0|v|p|1|100|src=1.2.3.4\tdst=5.6.7.8\tusrName=bob\tsev=9", {"source_ip": "1.2.3.4", "username": "bob", "severity": "HIGH"}),
    ("fortinet", 'date=2026-01-04 srcip=1.2.3.4 dstip=5.6.7.8 dstport=443 action="deny" user="bob"', {"source_ip": "1.2.3.4", "dest_port": 443, "action": "deny", "username": "bob"}),
    ("aws_vpc_flow", "2 123 eni-1 1.2.3.4 5.6.7.8 99 22 6 10 840 1700000000 1700000060 REJECT OK", {"source_ip": "1.2.3.4", "dest_port": 22, "protocol": "tcp", "action": "reject", "severity": "WARNING"}),
    ("azure_signin", '{"createdDateTime": "2026-01-04T10:00:01Z", "userPrincipalName": "bob@x", "ipAddress": "1.2.3.4", "status": {"errorCode": 50126}}', {"username": "bob@x", "source_ip": "1.2.3.4", "auth_result": "failure"}),
    ("gcp_audit", '{"timestamp": "2026-01-04T10:00:01Z", "protoPayload": {"methodName": "m", "authenticationInfo": {"principalEmail": "b@x"}, "requestMetadata": {"callerIp": "1.2.3.4"}, "authorizationInfo": [{"granted": true}]}}', {"username": "b@x", "action": "allow", "event_id": "m"}),
    ("mysql_error", "2026-01-04T10:00:01.000000Z 7 [Note] Access denied for user 'bob'@'1.2.3.4' (using password: YES)", {"username": "bob", "auth_result": "failure"}),
    ("postgresql", '2026-01-04 10:00:01.123 UTC [77] bob@db FATAL:  password authentication failed for user "bob"', {"username": "bob", "auth_result": "failure", "severity": "CRITICAL", "process_id": 77}),
    ("mongodb", '{"t": {"$date": "2026-01-04T10:00:01.000+00:00"}, "s": "W", "c": "ACCESS", "id": 20, "msg": "Auth failed", "attr": {"remote": "1.2.3.4:99"}}', {"severity": "WARNING", "source_ip": "1.2.3.4", "message": "Auth failed"}),
    ("kubernetes_audit", '{"requestReceivedTimestamp": "2026-01-04T10:00:01Z", "verb": "create", "user": {"username": "a"}, "sourceIPs": ["1.2.3.4"], "requestURI": "/api", "responseStatus": {"code": 403}}', {"username": "a", "action": "deny", "http_status": 403, "source_ip": "1.2.3.4"}),
    ("bind_query", "04-Jan-2026 10:00:01.123 queries: info: client @0x7f 1.2.3.4#5353 (a.example): query: aaaaaaaaaaaaaaaaaaaaaaaa.example IN A + (5.6.7.8)", {"source_ip": "1.2.3.4", "dns_type": "A", "severity": "WARNING"}),
    ("log4j", "2026-01-04 10:00:01,123 ERROR org.x.Main: it failed at 1.2.3.4", {"severity": "ERROR", "process_name": "org.x.Main", "source_ip": "1.2.3.4"}),
    ("fail2ban", "2026-01-04 10:00:01,123 fail2ban.actions        [77]: NOTICE  [sshd] Ban 1.2.3.4", {"action": "Ban", "source_ip": "1.2.3.4", "severity": "WARNING", "rule_name": "sshd"}),
    ("iis_w3c", "2026-01-04 10:00:01 5.6.7.8 GET /a id=1 80 - 1.2.3.4 Mozilla/5.0+(X) - 404 0 0 1", {"source_ip": "1.2.3.4", "http_uri": "/a?id=1", "http_user_agent": "Mozilla/5.0 (X)", "http_status": 404}),
    ("android_logcat", "01-04 10:00:01.123  77  78 E ActivityManager: crash", {"process_id": 77, "severity": "ERROR", "process_name": "ActivityManager"}),
    ("openstack", "nova-api.log 2026-01-04 10:00:01.123 77 WARNING nova.api [req-1-2 u t] 1.2.3.4 denied", {"process_name": "nova.api", "severity": "WARNING", "event_id": "req-1-2", "source_ip": "1.2.3.4"}),
    ("paloalto", '1,2026/01/04 10:00:01,0123,TRAFFIC,end,1,bob,1.2.3.4,5.6.7.8,0.0.0.0,0.0.0.0,"allow, web",u,v,app,vsys1,a,b,c,d,e,f,1,1,50000,443,0,0,0x0,TCP,Deny,x,y,840', {"timestamp": datetime(2026, 1, 4, 10, 0, 1), "source_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "source_port": 50000, "dest_port": 443, "protocol": "tcp", "action": "deny", "username": "bob", "http_bytes": 840, "severity": "WARNING", "rule_name": "allow, web", "message": "PAN-OS TRAFFIC: deny tcp 1.2.3.4 -> 5.6.7.8"}),
    ("paloalto", '1,2026/01/04 10:00:01,0123,THREAT,url,1,"x ""y"", z",1.2.3.4,5.6.7.8,0,0,r,u,v,app,vsys1,Critical,b,c,d,e,f,1,1,50000,443,0,0,0x0,tcp,alert,"evil, page"', {"timestamp": datetime(2026, 1, 4, 10, 0, 1), "source_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "source_port": None, "action": None, "username": None, "message": "evil, page", "severity": "CRITICAL"}),
    ("paloalto", "1,2026/01/04 10:00:01,0123,SYSTEM,a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p", {"timestamp": None, "source_ip": None, "severity": "INFO", "message": "1,2026/01/04 10:00:01,0123,SYSTEM,a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p"}),
    ("paloalto", '1,2026/01/04 10:00:01,0123,TRAFFIC,"a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r"', {"timestamp": None, "source_ip": None, "severity": None}),
    ("macos_install", "2026-01-04 10:00:01-07 installd 77 Error it failed", {"timestamp": datetime(2026, 1, 4, 17, 0, 1), "process_name": "installd", "process_id": 77, "severity": "ERROR", "message": "it failed", "hostname": None}),
    ("macos_install", "Jan  2 03:04:05 mac1 ReportCrash[12]: Saved crash", {"timestamp": datetime(2024, 1, 2, 3, 4, 5), "hostname": "mac1", "process_name": "ReportCrash", "process_id": 12, "severity": "INFO", "message": "Saved crash"}),
    ("macos_crashreporter", "Jan 12 03:04:05.678 mac1 com.apple.x [12] <Alert>: gone", {"timestamp": datetime(2024, 1, 12, 3, 4, 5), "process_name": "com.apple.x", "severity": "CRITICAL", "message": "gone"}),
    ("macos_install", "at 2026-01-04T10:00:01 something", {"timestamp": datetime(2026, 1, 4, 10, 0, 1), "message": "at 2026-01-04T10:00:01 something", "process_name": None}),
    ("mongodb", "2026-01-04T10:00:01.123+0000 E NETWORK  [conn77] connection refused", {"timestamp": datetime(2026, 1, 4, 10, 0, 1, 123000), "severity": "ERROR", "message": "connection refused", "source_ip": None}),
    ("mongodb", '{"t": {"$date": "2026-01-04T10:00:01.000+00:00"}, "s": "I", "ctx": "conn-42", "msg": "m", "attr": {"remote": "1.2.3.4:99", "principalName": "bob"}}', {"process_id": 42, "username": "bob", "severity": "INFO", "source_ip": "1.2.3.4"}),
    ("falco", "11:30:02.450022704: Warning Sensitive file opened for reading (user=root)", {"severity": "WARNING", "message": "Sensitive file opened for reading (user=root)", "timestamp": None}),
    ("falco", '{"time": "2026-01-04T10:00:01Z", "priority": "Critical", "rule": "r", "output": "o", "output_fields": {"proc.name": "sh", "proc.pid": 7, "proc.cmdline": "sh -c x", "user.name": "bob", "container.id": "c1", "fd.name": "/etc/shadow"}}', {"timestamp": datetime(2026, 1, 4, 10, 0, 1), "severity": "CRITICAL", "message": "o", "process_name": "sh", "process_id": 7, "command_line": "sh -c x", "username": "bob", "hostname": "c1", "file_path": "/etc/shadow"}),
    ("linux_syslog", "Jan  4 10:00:01 web1 CRON[77]: (root) CMD (/usr/bin/x --y)", {"command_line": "/usr/bin/x --y", "process_name": "CRON", "severity": "INFO", "timestamp": datetime(2024, 1, 4, 10, 0, 1)}),
    ("linux_syslog", "2026-01-04 10:00:01 install nginx:amd64 <none> 1.2", {"timestamp": datetime(2026, 1, 4, 10, 0, 1), "extra": {"dpkg_action": "install", "dpkg_package": "nginx:amd64"}, "message": "2026-01-04 10:00:01 install nginx:amd64 <none> 1.2"}),
    ("linux_syslog", "Jan  4 10:00:01 web1 kernel: Out of memory: Killed process 77", {"severity": "CRITICAL"}),
    ("linux_syslog", "Jan  4 10:00:01 web1 fail2ban[7]: fail2ban.actions NOTICE [sshd] Ban 1.2.3.4", {"source_ip": "1.2.3.4", "severity": "WARNING", "extra": {"fail2ban_jail": "sshd", "fail2ban_action": "Ban"}}),
    ("openssh", "Jan  4 10:00:01 web1 sshd[7]: Accepted publickey for bob from 1.2.3.4 port 99 ssh2", {"username": "bob", "source_ip": "1.2.3.4", "source_port": 99, "auth_result": "success", "severity": "INFO", "extra": {"auth_method": "publickey"}}),
    ("openssh", "Jan  4 10:00:01 web1 sshd[7]: error: maximum authentication attempts exceeded for root from 1.2.3.4 port 9", {"source_ip": "1.2.3.4", "auth_result": "failure", "severity": "CRITICAL", "extra": {"tag": "brute_force"}}),
    ("openssh", "Jan  4 10:00:01 web1 sshd[7]: Accepted direct-tcpip channel 1 to 5.6.7.8:3306 by x from 1.2.3.4", {"dest_ip": "5.6.7.8", "dest_port": 3306, "source_ip": "1.2.3.4", "severity": "WARNING"}),
    ("openssh", "Jan  4 10:00:01 web1 sshd[7]: Failed password for root from 1.2.3.4 port 9 ssh2", {"username": "root", "auth_result": "failure", "severity": "WARNING", "extra": None}),
    ("unknown", "2026-01-04 10:00:01 user=bob from 1.2.3.4 to 5.6.7.8 port 22 error", {"source_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "username": "bob", "severity": "ERROR", "source_port": 22}),
]


@pytest.mark.parametrize("name", sorted({c[0] for c in CASES}))
def test_format(spark, name):
    cases = [c for c in CASES if c[0] == name]
    lines = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)] + [(99, "no line of this kind"), (100, "")], "line_number long, raw_line string")
    got = {r["line_number"]: r for r in formats.normalise(lines, name).collect()}
    assert len(got) == len(cases) + 2  # a line that doesn't match keeps its row
    for i, c in enumerate(cases):
        assert {k: got[i][k] for k in c[2]} == c[2]


def test_every_format_gives_event_columns(spark):
    lines = spark.createDataFrame([(1, "x"), (2, None)], "line_number long, raw_line string")
    columns = None
    assert len(formats.FORMATS) >= 100
    for name in sorted({f.__name__: n for n, f in formats.FORMATS.items()}.values()):
        df = formats.normalise(lines, name)
        columns = columns or df.dtypes
        assert df.dtypes == columns, name
    assert formats.normalise_mixed(lines.selectExpr("*", "'squid' as log_format"), ["squid", "cef"]).count() == 2


def lines_of(spark, files):
    rows = [(name, i + 1, text) for name, texts in files.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "source_file string, line_number long, raw_line string")


def test_detection_of_formats(spark):
    sample = {name: text for name, text, _ in reversed(CASES)}
    by_content = {"apache_combined": "apache_combined", "auth_log": "auth_log", "json_lines": "json_generic", "aws_cloudtrail": "aws_cloudtrail", "squid": "squid", "cisco_asa": "cisco_asa", "cef": "cef", "leef": "ai_parsed", "snort_fast": "snort_fast", "auditd": "auditd", "fail2ban": "fail2ban", "mysql_error": "mysql_error", "android_logcat": "android_logcat", "syslog_rfc5424": "syslog"}  # LEEF 1.0 meets no probe; a name counts before content
    files = {f"/x/{name}.bin": ["", sample[name], sample[name]] for name in by_content}
    want = {f"/x/{k}.bin": v for k, v in by_content.items()}
    more = {
        "/x/u_ex260104.txt": (["nothing"], "iis_w3c"), "/x/a.jsonl": (["nothing"], "json_lines"), "/x/Auth.log.1": (["nothing"], "auth_log"), "/x/plain.bin": (["free text"], "ai_parsed"), "/x/array.bin": (['[{"a": 1}]'], "json_generic"),
        "/x/conn.bin": (["#fields\tts\tuid\tid.orig_h", "1\t2\t3"], "zeek_conn"), "/x/late.bin": (["x"] * 15 + [sample["cef"]], "ai_parsed"),
        # Apache has more points, but there are logins
        "/x/both.bin": ([sample["apache_combined"]] * 5 + [sample["auth_log"]], "auth_log"), "/x/magic.log": (["nothing"], "windows_evtx"),
    }
    files |= {k: v[0] for k, v in more.items()}
    magic = spark.createDataFrame([("/x/magic.log", b"ElfFile\0"), ("/x/plain.bin", b"MZ")], "source_file string, head binary")
    got = {r["source_file"]: r["log_format"] for r in probing.file_format(lines_of(spark, files), magic).collect()}
    assert got == want | {k: v[1] for k, v in more.items()}
    one = lines_of(spark, {"f": [sample["cef"], "free text"]}).select(probing.line_format("raw_line").alias("f"))
    assert [r["f"] for r in one.collect()] == ["cef", "ai_parsed"]


def test_columns_by_header(spark):
    files = {
        "a": ["#Software: Microsoft IIS", "#Fields: date time c-ip cs-method cs-uri-stem sc-status", "2026-01-04 10:00:01 1.2.3.4 GET /a 404"],
        "b": ["2026-01-04 10:00:01 5.6.7.8 GET /b id=1 80 - 1.2.3.9 Mozilla/5.0+(X) - 200 0 0 1"],
    }
    got = {r["source_file"]: r for r in probing.parse_with_header(lines_of(spark, files), "iis_w3c").collect()}
    assert (got["a"]["source_ip"], got["a"]["http_uri"], got["a"]["http_status"], got["a"]["http_method"]) == ("1.2.3.4", "/a", 404, "GET")
    assert (got["b"]["source_ip"], got["b"]["http_uri"], got["b"]["http_status"]) == ("1.2.3.9", "/b?id=1", 200)
    flow = {"v": ["version srcaddr dstaddr dstport action protocol start", "2 1.2.3.4 5.6.7.8 22 REJECT 6 1700000000"], "w": ["2 123 eni-1 1.2.3.4 5.6.7.8 99 23 6 10 840 1700000000 1700000060 ACCEPT OK"]}
    got = {r["source_file"]: r for r in probing.parse_with_header(lines_of(spark, flow), "aws_vpc_flow").collect()}
    assert (got["v"]["source_ip"], got["v"]["dest_port"], got["v"]["action"], got["v"]["protocol"]) == ("1.2.3.4", 22, "reject", "tcp")
    assert (got["w"]["dest_port"], got["w"]["action"]) == (23, "accept")
    wall = {"f": ["#Fields: date time action protocol dst-ip src-ip dst-port src-port", "2026-01-04 10:00:01 DROP TCP 5.6.7.8 1.2.3.4 445 99"]}
    r = probing.parse_with_header(lines_of(spark, wall), "windows_firewall").first()
    assert (r["source_ip"], r["dest_ip"], r["dest_port"], r["action"]) == ("1.2.3.4", "5.6.7.8", 445, "drop")


def test_rejects_and_statistics(spark):
    lines = lines_of(spark, {"f": [CASES[0][1], "nonsense", "y" * 300]})
    parsed = formats.normalise(lines, "apache_combined")
    assert sorted(map(tuple, probing.rejects(lines, parsed, 250).collect())) == [("f", 2, "unparsed"), ("f", 3, "too_long")]
    r = probing.statistics(parsed).first()
    assert (r["lines"], r["ok"], r["errors"], r["ips"], r["span"]) == (3, 1, 2, 1, 0)


def test_own_format(spark):
    formats.register_format("mine", lambda x: {"source_ip": formats.part(x, r"from=(\S+)", 1)})
    assert formats.normalise(lines_of(spark, {"f": ["from=1.2.3.4"]}), "mine").first()["source_ip"] == "1.2.3.4"
    del formats.FORMATS["mine"]


def test_readers(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("one\r\n\n  \ntwo\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("three\n")
    assert sorted(r["raw_line"] for r in formats.read_lines(spark, str(tmp_path / "*.log*")).collect()) == ["one", "three", "two"]
    assert [r["too_long"] for r in formats.read_lines(spark, str(tmp_path / "b.log.gz"), 3).collect()] == [True]
    (tmp_path / "j.json").write_text('{"Records": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "k.json").write_text('[{"a": 3}]')
    (tmp_path / "l.json").write_text('{"a": 4}')
    got = formats.read_json_records(spark, str(tmp_path / "*.json")).collect()
    assert sorted(r["raw_line"] for r in got) == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":4}']


def test_address_classes(spark):
    want = {"127.0.0.1": "loopback", "224.0.0.5": "multicast", "203.0.113.9": "documentation", "10.1.2.3": "private", "8.8.8.8": "public", "300.1.1.1": "invalid", "x": "invalid"}
    rows = spark.createDataFrame([(k,) for k in want], "ip string").select("ip", core.ip_class("ip").alias("c"))
    assert {r["ip"]: r["c"] for r in rows.collect()} == want
    core.register_sql_functions(spark)
    assert [r[0] for r in spark.sql("select ip_class('10.1.2.3') union all select ip_class('x')").collect()] == ["private", "invalid"]


def test_mixed_files_by_their_headers(spark):
    """Files of one format with a header, with another, and without; and one of a format without headers."""
    line = "1700000000.5\tC1\t1.2.3.4\t99\t5.6.7.8\t443\ttcp\tssl\t1.0\t2000000\t5\tSF"
    rows = [("plain", 1, "zeek_conn", line), ("head", 1, "zeek_conn", "#fields\tid.resp_p\tid.orig_h\tts"), ("head", 2, "zeek_conn", "#types\tport\taddr\ttime"), ("head", 3, "zeek_conn", "22\t9.9.9.9\t1700000001"), ("head", 4, "zeek_conn", "-\t9.9.9.8"),
            ("flow", 1, "aws_vpc_flow", "version srcaddr action dstport"), ("flow", 2, "aws_vpc_flow", "2 4.4.4.4 REJECT 23"), ("web", 1, "apache_combined", '7.7.7.7 - - [04/Jan/2026:10:00:01 +0000] "GET /#fields HTTP/1.1" 200 5')]
    lines = spark.createDataFrame(rows, "source_file string, line_number long, log_format string, raw_line string")
    got = {(r["source_file"], r["line_number"]): r for r in probing.normalise_files(lines, ["zeek_conn", "aws_vpc_flow", "apache_combined"]).collect()}
    assert set(got) == {("plain", 1), ("head", 3), ("head", 4), ("flow", 2), ("web", 1)}
    assert (got["plain", 1]["source_ip"], got["plain", 1]["dest_port"], got["plain", 1]["severity"]) == ("1.2.3.4", 443, "WARNING")
    assert (got["head", 3]["source_ip"], got["head", 3]["dest_port"], got["head", 3]["dest_ip"]) == ("9.9.9.9", 22, None)
    assert (got["head", 4]["source_ip"], got["head", 4]["dest_port"], got["head", 4]["timestamp"]) == ("9.9.9.8", None, None)
    assert (got["flow", 2]["source_ip"], got["flow", 2]["dest_port"], got["flow", 2]["action"]) == ("4.4.4.4", 23, "reject")
    assert got["web", 1]["http_uri"] == "/#fields"
    by_place = formats.normalise(lines.where("source_file = 'plain'"), "zeek_conn").first()
    assert {c: got["plain", 1][c] for c in formats.EVENT_COLUMNS} == {c: by_place[c] for c in formats.EVENT_COLUMNS}
