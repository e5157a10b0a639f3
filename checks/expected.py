"""What the Python snippets must yield, by snippet id and line within the snippet."""

# (sid, rule_id, detector, type, line, snippet)
RULES = [
    (2, "P1", 2, "Insecure Function Usage", 1, "value = eval(text)"),
    (2, "P1", 2, "Insecure Function Usage", 2, "exec(code)"),
    (2, "P1", 2, "Insecure Function Usage", 3, 'tree = compile(code, "x", "exec")'),
    (2, "P1", 2, "Insecure Function Usage", 4, "name = input()"),
    (3, "P3", 2, "Suspicious Subprocess Call", 4, 'subprocess.run("ls", shell=True)'),
    (3, "P3", 2, "Suspicious Subprocess Call", 5, 'subprocess.Popen(["ls"])'),
    (3, "P4", 3, "Dangerous Import", 1, "import os, subprocess"),
    (3, "P4", 3, "Dangerous Import", 1, "import os, subprocess"),
    (3, "P5", 3, "Dangerous Import", 2, "from subprocess import run"),
    (3, "P5", 3, "Dangerous Import", 3, "from os import path"),
    (4, "P2", 2, "Insecure Function Usage", 2, "a = pickle.loads(blob)"),
    (4, "P2", 2, "Insecure Function Usage", 3, "b = pickle.load(handle)"),
    (5, "P6", 4, "Deprecated Hash", 1, "digest = hashlib.md5(data).hexdigest()"),
    (5, "P6", 4, "Deprecated Hash", 2, "weak = hashlib.sha1"),
    (6, "P9", 5, "Possible SQL Injection", 2, "cursor.execute(query)"),
    (6, "P9", 5, "Possible SQL Injection", 4, "cursor.execute(sql)"),
    (6, "P8", 5, "Possible SQL Injection", 6, 'cursor.execute("select 1 from t")'),
    (6, "P8", 5, "Possible SQL Injection", 7, 'cursor.execute("select a from t where b = %s" % b)'),
    (6, "P7", 5, "Possible SQL Injection", 8, 'row = "select x from " + "%s" % y'),
    (6, "P9", 5, "Possible SQL Injection", 12, "cursor.executemany(late)"),
    (7, "P10", 6, "Insecure Regex", 2, 'p = re.compile(".*")'),
    (7, "P10", 6, "Insecure Regex", 3, 'q = re.search("a.*b", text)'),
    (7, "P10", 6, "Insecure Regex", 4, 'r = re.match("^.*$", text)'),
    (21, "P1", 2, "Insecure Function Usage", 1, "eval(built)"),
]

# (sid, kind, name, parent, args, value, line)
FACTS = [
    (0, 'function', 'add', None, 'a, b', None, 1),
    (1, 'assignment', 'password', None, None, "'hunter-two'", 1),
    (1, 'assignment', 'API_KEY', None, None, "'demo-key-0123456789abcd'", 2),
    (1, 'string', None, None, None, 'hunter-two', 1),
    (1, 'string', None, None, None, 'demo-key-0123456789abcd', 2),
    (2, 'assignment', 'value', None, None, 'eval(text)', 1),
    (2, 'assignment', 'tree', None, None, "compile(code, 'x', 'exec')", 3),
    (2, 'assignment', 'name', None, None, 'input()', 4),
    (2, 'string', None, None, None, 'x', 3),
    (2, 'string', None, None, None, 'exec', 3),
    (3, 'imported', 'os', None, None, None, 1),
    (3, 'imported', 'subprocess', None, None, None, 1),
    (3, 'imported', 'subprocess.run', None, None, None, 2),
    (3, 'imported', 'os.path', None, None, None, 3),
    (3, 'string', None, None, None, 'ls', 4),
    (3, 'string', None, None, None, 'ls', 6),
    (3, 'string', None, None, None, 'ls', 5),
    (4, 'imported', 'pickle', None, None, None, 1),
    (4, 'assignment', 'a', None, None, 'pickle.loads(blob)', 2),
    (4, 'assignment', 'b', None, None, 'pickle.load(handle)', 3),
    (4, 'assignment', 'c', None, None, 'yaml.load(text)', 4),
    (4, 'assignment', 'd', None, None, 'marshal.loads(blob)', 5),
    (5, 'assignment', 'digest', None, None, 'hashlib.md5(data).hexdigest()', 1),
    (5, 'assignment', 'weak', None, None, 'hashlib.sha1', 2),
    (5, 'assignment', 'token_value', None, None, 'random.randint(0, 9)', 3),
    (5, 'assignment', 'reply', None, None, 'requests.get(url, verify=False)', 4),
    (5, 'assignment', 'DEBUG', None, None, 'True', 5),
    (6, 'assignment', 'query', None, None, '"SELECT * FROM t WHERE n = \'" + name + "\'"', 1),
    (6, 'assignment', 'sql', None, None, "f'select id from t where n = {name}'", 3),
    (6, 'assignment', 'row', None, None, "'select x from ' + '%s' % y", 8),
    (6, 'assignment', 'late', None, None, "'plain'", 9),
    (6, 'assignment', 'late', None, None, "'delete from t where id = {}'.format(key)", 11),
    (6, 'string', None, None, None, 'plain', 9),
    (6, 'string', None, None, None, "'", 1),
    (6, 'string', None, None, None, 'select id from t where n = ', 3),
    (6, 'string', None, None, None, 'select 1 from t', 6),
    (6, 'string', None, None, None, 'select x from ', 8),
    (6, 'string', None, None, None, "SELECT * FROM t WHERE n = '", 1),
    (6, 'string', None, None, None, 'select a from t where b = %s', 7),
    (6, 'string', None, None, None, '%s', 8),
    (6, 'string', None, None, None, 'delete from t where id = {}', 11),
    (6, 'string', None, None, None, 'SELECT UP FROM T', 14),
    (7, 'imported', 're', None, None, None, 1),
    (7, 'assignment', 'p', None, None, "re.compile('.*')", 2),
    (7, 'assignment', 'q', None, None, "re.search('a.*b', text)", 3),
    (7, 'assignment', 'r', None, None, "re.match('^.*$', text)", 4),
    (7, 'assignment', 's', None, None, "re.match('a.*bcdefghijk', text)", 5),
    (7, 'assignment', 't', None, None, 'tempfile.mktemp()', 6),
    (7, 'assignment', 'h', None, None, "open(user + '.txt')", 8),
    (7, 'string', None, None, None, '.*', 2),
    (7, 'string', None, None, None, 'a.*b', 3),
    (7, 'string', None, None, None, '^.*$', 4),
    (7, 'string', None, None, None, 'a.*bcdefghijk', 5),
    (7, 'string', None, None, None, '.txt', 8),
    (8, 'class', 'Box', None, None, 'A box.', 8),
    (8, 'method', 'put', 'Box', 'self, item', 'Put it.', 13),
    (8, 'method', 'take', 'Box', 'self', None, 21),
    (8, 'function', 'put', None, 'self, item', 'Put it.', 13),
    (8, 'function_call', 'len', 'put', 'self.items', None, 19),
    (8, 'function_call', 'items.append', 'put', 'item', None, 16),
    (8, 'function_call', 'requests.post', 'put', "'http://h.example'", None, 18),
    (8, 'function', 'take', None, 'self', None, 21),
    (8, 'function_call', 'items.pop', 'take', '0', None, 24),
    (8, 'class', 'Inner', None, None, None, 28),
    (8, 'method', 'ping', 'Inner', 'self', None, 29),
    (8, 'function', 'ping', None, 'self', None, 29),
    (8, 'function_call', 'socket.create_connection', 'ping', "('h', 1)", None, 30),
    (8, 'function', 'outer', None, 'n', None, 33),
    (8, 'function_call', 'inner(n)', 'outer', 'label', None, 37),
    (8, 'function_call', 'client.HTTPConnection', 'outer', 'm', None, 35),
    (8, 'function_call', 'inner', 'outer', 'n', None, 37),
    (8, 'function', 'inner', None, 'm', None, 34),
    (8, 'function_call', 'client.HTTPConnection', 'inner', 'm', None, 35),
    (8, 'imported', 'requests', None, None, None, 2),
    (8, 'imported', 'urllib.request', None, None, None, 3),
    (8, 'imported', 'http.client', None, None, None, 4),
    (8, 'imported', 'local', None, None, None, 5),
    (8, 'string', None, None, None, 'Module notes.', 1),
    (8, 'assignment', 'limit', None, None, '3', 11),
    (8, 'assignment', 'label', None, None, "f'n={n}'", 36),
    (8, 'assignment', 'other', None, None, "f'n={n}'", 36),
    (8, 'string', None, None, None, 'A box.', 9),
    (8, 'control', 'if', None, None, 'item', 15),
    (8, 'control', 'for', None, None, 'part', 17),
    (8, 'control', 'while', None, None, 'self.items', 22),
    (8, 'string', None, None, None, 'Put it.', 14),
    (8, 'control', 'try', None, None, None, 23),
    (8, 'string', None, None, None, 'n=', 36),
    (8, 'string', None, None, None, 'http://h.example', 18),
    (8, 'string', None, None, None, 'h', 30),
    (8, 'comment', None, None, None, '# tail note', 37),
]
