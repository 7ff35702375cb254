"""Vocabularies, patterns and thresholds that results depend on. Data only, in natural order."""

# Verbose regular expressions. name, score, strong, allowlist, pattern.
STRUCTURAL_SIGNALS = [
    ('has_shell_substitution', 0, False, None, r"""(?x)
(?:
    `[^`\n]{1,200}`
  | \$\([^)\n]{0,200}\)
  | \$\{\w{1,64}\}
  | \$[A-Za-z_]\w{0,63}
)
"""),
    ('has_windows_path', 0, False, None, r"""(?ix)
(?:
    (?:^|[\s"',;(\[])[A-Za-z]:[\\/]
  | \\\\[A-Za-z0-9._-]{1,64}\\
  | [A-Za-z0-9._-]{1,64}\\[A-Za-z0-9._-]{1,64}\\
)
"""),
    ('has_serialized_config', 0, False, None, r"""(?x)
\{\s*["'][A-Za-z_][\w.-]{0,63}["']\s*:
"""),
    ('has_path_traversal', 0, False, None, r"""(?ix)
(?:\.\.[/\\])+
(?:
    tmp|etc|proc|sys|dev|boot|sbin|root|
    windows|winnt|system32|programdata|
    \.ssh|\.aws|\.gnupg|\.docker|\.kube
)
(?:[/\\]|$)
"""),
]

SHELL_SHORTCUTS = [
    ('SHORT_SHELL_CMD_RE', 0, False, None, r"""(?ix)
^\s*
(?:
    echo\s+.+ |
    ls(?:\s+-[A-Za-z]+)*(?:\s+(?:[~/]\S*|\.{1,2}[/\\]\S*))* |
    id |
    whoami |
    uname(?:\s+-[a-z]+)? |
    pwd |
    touch(?:\s+.+)? |
    [a-z0-9][a-z0-9_.-]{0,63}\.exe(?:\s+.+)? |
    date
)
\s*$
"""),
]

SHELL_PATTERNS = [
    ('SHELL_CMD_RE', 1, False, None, r"""(?ix)
(?:^|[\s"'`({\[]|;|&&|\|\|)
(?:
    curl|wget|nc|netcat|ssh|scp|socat|
    bash|sh|zsh|fish|
    chmod|chown|rm|mv|cp|cat|echo|find|touch|
    perl|python(?:3)?|node|ruby|
    apt(?:-get)?|yum|dnf|pacman|brew|
    powershell|pwsh|cmd(?:\.exe)?|
    certutil(?:\.exe)?|bitsadmin(?:\.exe)?|msiexec(?:\.exe)?|
    regsvr32(?:\.exe)?|rundll32(?:\.exe)?|mshta(?:\.exe)?|
    wmic(?:\.exe)?|schtasks(?:\.exe)?|reg(?:\.exe)?|
    awk|xargs|vim|vi|nmap|env|tee|dd|
    # LOLBAS — Script Host
    wscript(?:\.exe)?|cscript(?:\.exe)?|
    installutil(?:\.exe)?|regasm(?:\.exe)?|regsvcs(?:\.exe)?|odbcconf(?:\.exe)?|
    desktopimgdownldr(?:\.exe)?|ieexec(?:\.exe)?|esentutl(?:\.exe)?|
    forfiles(?:\.exe)?|pcalua(?:\.exe)?|diskshadow(?:\.exe)?|
    [a-z0-9][a-z0-9_.-]{0,63}\.exe|
    #
    #
    (?:
        git|twine|pip3?|
        systemctl|supervisorctl|systeminfo|
        netsh|nslookup|dig|ifconfig|
        lspci|sysctl|pgrep|pkill|
        xattr|pyinstaller
    )(?=\s+\S)|
    (?:
        git|twine|pip3?|
        systemctl|supervisorctl|systeminfo|
        netsh|nslookup|dig|ifconfig|
        lspci|sysctl|pgrep|pkill|
        xattr|pyinstaller
    )[|;&]\S*(?=\s|$)|
    7za?(?=\s+(?:[axeudlt]\b|-))|
    start\s+\S+\.(?:exe|bat|cmd|vbs|ps1|scr|js)|
    shutdown\s+[-/]\w|
    #
    #
    #
    (?:
        mkdir|rmdir|printf|mkfifo|mknod|readlink|realpath|basename|dirname|
        chgrp|umask|nohup|killall|getent|logname|uptime|
        gzip|gunzip|bzip2|bunzip2|unzip|cpio|shred|truncate|install|
        sed|grep|egrep|fgrep|seq|sleep|timeout|
        tar|wc|du|df|ln|od|nl|split|stat|sync|nice|tr|
        head|tail|sort|cut|paste|comm|fold|uniq|join|yes|wait|last|who
    )
    (?=\s+(?:[-/%$~]|["']|\S*[/\\=.]))
)
(?:\s+|$)
"""),
    ('SHELL_INTERPRETER_C_RE', 2, False, None, r"""(?ix)
(?:^|[\s"'`({\[]|;|&&|\|\|)
(?:
    python(?:3)?|perl|node|ruby|bash|sh|zsh|
    pwsh|powershell
)
\s*-\s*c
(?:\s+|$)
"""),
    ('SHELL_META_RE', 1, False, None, r"""(?x)
(?:\|\||&&|>>|<<|[|]|[<>]|
   \$\(|`.+?`|\$\{[^}]+\}|
   \$\w+|
   \%\w+\%|
   \^|
   \r?\n
)
"""),
    ('SHELL_PATH_HINT_RE', 1, False, None, r"""(?ix)
(?:
    /tmp/|/bin/|/usr/bin/|/etc/|
    \.bashrc|\.zshrc|
    /dev/tcp/|
    \\windows\\system32\\|
    \\windows\\syswow64\\|
    \\users\\public\\|
    \\programdata\\|
    \\temp\\|\\appdata\\local\\temp\\
)
"""),
    ('NATIVE_LIB_PATH_RE', 2, True, None, r"""(?ix)
[^\s'"/\\]{0,200}\.(?:so|dll|dylib)(\.[0-9]+)?\b
"""),
    ('POWERSHELL_CRADLE_RE', 3, True, None, r"""(?isx)
\b(powershell|pwsh)\b
(?:
    .{0,200}\b(net\.webclient)\b.{0,200}\b(downloadstring|downloadfile)\b
  |
    .{0,200}\b(invoke-webrequest|invoke-restmethod|\biwr\b|\birm\b)\b
)
.{0,300}\b(iex|invoke-expression)\b
"""),
    ('POWERSHELL_STEALTH_OPTS_RE', 2, True, None, r"""(?isx)
\b(powershell|pwsh)\b
.{0,200}\B-\s*(enc|encodedcommand)\b
|
\b(powershell|pwsh)\b
.{0,200}\B-\s*(nop|noprofile|w\s*hidden|windowstyle\s*hidden|noni|noninteractive)\b
"""),
    ('SVCHOST_TYPO_RE', 3, True, 'SVCHOST_LEGIT_PATH_RE', r"""(?ix)
\b(svch0st|svh0st|svhost|svchst|svchot|svchostexe)\.exe\b
"""),
    ('LOLBIN_CERTUTIL_URLCACHE_RE', 3, True, None, r"""(?isx)
\bcertutil(?:\.exe)?\b
.{0,200}\B-\s*(urlcache|verifyctl)\b
.{0,200}\B-\s*f\b
.{0,300}https?://
"""),
    ('LOLBIN_BITSADMIN_TRANSFER_RE', 3, True, None, r"""(?isx)
\bbitsadmin(?:\.exe)?\b
.{0,200}\B/\s*transfer\b
.{0,200}\B/\s*download\b
.{0,400}https?://
"""),
    ('LOLBIN_BITSADMIN_JOBCHAIN_RE', 3, True, None, r"""(?isx)
\bbitsadmin(?:\.exe)?\b
.{0,400}\B/\s*(create|addfile|resume|complete|setnotifycmdline|reset)\b
"""),
    ('LOLBIN_MSIEXEC_REMOTE_TRANSFORM_RE', 3, True, None, r"""(?isx)
\bmsiexec(?:\.exe)?\b
.{0,300}\b/i\b
.{0,400}\btransforms\s*=\s*["']?https?://[^"'\s]+\.mst["']?
"""),
    ('LOLBIN_REGSVR32_SCT_RE', 3, True, None, r"""(?isx)
\bregsvr32(?:\.exe)?\b
.{0,300}\b/i:\s*https?://[^\s"']+\.sct\b
.{0,300}\bscrobj\.dll\b
"""),
    ('LOLBIN_RUNDLL32_JS_RE', 3, True, None, r"""(?isx)
\brundll32(?:\.exe)?\b
.{0,400}javascript:
.{0,400}getobject\(\s*["']script:https?://
"""),
    ('GTFO_BASH_DEVTCP_RE', 3, True, None, r"""(?isx)
\bbash\b
.{0,120}\B-\s*c\b
.{0,600}/dev/tcp/[^/\s]+/\d+
"""),
    ('GTFO_SOCAT_EXEC_SH_RE', 3, True, None, r"""(?isx)
\bsocat\b
.{0,500}\b(exec:/bin/sh)\b
"""),
    ('GTFO_FIND_EXEC_SH_RE', 3, True, None, r"""(?isx)
\bfind\b
.{0,500}\B-\s*exec\b
.{0,200}(?:/bin/sh|sh)\b
"""),
    ('GTFO_AWK_SYSTEM_RE', 3, True, None, r"""(?isx)
\bawk\b
.{0,300}BEGIN\s*\{
.{0,300}(?:system\s*\(|"/bin/sh"|"/bin/bash"|cmd\s*\()
"""),
    ('GTFO_XARGS_SHELL_RE', 3, True, None, r"""(?isx)
\bxargs\b
.{0,200}\B-\s*[Ii]\b
.{0,200}(?:bash|sh|zsh)\s+-c\b
"""),
    ('GTFO_VIM_EXEC_RE', 3, True, None, r"""(?isx)
\bvi(?:m)?\b
.{0,300}(?:-c\s+['"]?\s*:\s*!\s*|:silent\s*!\s*|:system\s*\()
"""),
    ('GTFO_NMAP_EXEC_RE', 3, True, None, r"""(?isx)
\bnmap\b
.{0,400}(?:--script-exec\b|--script\s*=\s*\S*exec|-e\s+/bin/)
"""),
    ('LOLBIN_WSCRIPT_CSCRIPT_RE', 3, True, None, r"""(?isx)
\b(?:wscript|cscript)(?:\.exe)?\b
.{0,400}(?:\.(?:vbs|js|jse|vbe|wsf)\b|//e:(?:jscript|vbscript)|//b\b|/b\b)
"""),
    ('LOLBIN_MSHTA_EXEC_RE', 3, True, None, r"""(?isx)
\bmshta(?:\.exe)?\b
.{0,400}(?:vbscript:|javascript:|https?://[^\s"']+\.hta\b)
"""),
    ('LOLBIN_FORFILES_CMD_RE', 3, True, None, r"""(?isx)
\bforfiles(?:\.exe)?\b
.{0,400}/c\b
.{0,200}cmd\b
"""),
    ('LOLBIN_ODBCCONF_RE', 3, True, None, r"""(?isx)
\bodbcconf(?:\.exe)?\b
.{0,300}(?:/a\b|/f\b)
.{0,200}(?:REGSVR|\.dll\b)
"""),
    ('LOLBIN_INSTALLUTIL_RE', 3, True, None, r"""(?isx)
\bInstallUtil(?:\.exe)?\b
.{0,200}(?:/U\b|/uninstall\b)
"""),
    ('LOLBIN_REGASM_REGSVCS_RE', 3, True, None, r"""(?isx)
\b(?:regasm|regsvcs)(?:\.exe)?\b
.{0,200}(?:/U\b|/uninstall\b|/codebase\b)
"""),
    ('LOLBIN_DESKTOPIMGDOWNLDR_RE', 3, True, None, r"""(?isx)
\bdesktopimgdownldr(?:\.exe)?\b
.{0,200}/lockscreenurl\s*:
.{0,300}https?://
"""),
    ('LOLBIN_IEEXEC_RE', 3, True, None, r"""(?isx)
\bieexec(?:\.exe)?\b
.{0,200}https?://
"""),
]

SHELL_ALLOWLIST = [
    ('SVCHOST_LEGIT_PATH_RE', 0, False, None, r"""(?ix)
\\windows\\system32\\svchost\.exe\b
"""),
]

PYTHON_SHORTCUTS = [
    ('PY_EXEC_GATEWAY_CALL_RE', 0, False, None, r"""(?x)
\b(?:eval|exec|execfile|compile|__import__)\s*\(
"""),
    ('PY_OS_EXEC_CALL_RE', 0, False, None, r"""(?x)
\b(?:
    os\.(?:system|popen|execv[pe]{0,2}|spawn[lv]p?e?)
  | subprocess\.(?:run|call|check_call|check_output|Popen|getoutput)
  | pty\.spawn
  | commands\.get(?:status)?output
)\s*\(
"""),
    ('PY_SANDBOX_ESCAPE_CHAIN_RE', 0, False, None, r"""(?x)
__(?:class|base|bases|mro|subclasses|globals|builtins|import__|
    reduce__|reduce_ex__|getattr__|code__|closure__)__
"""),
]

PYTHON_PATTERNS = [
    ('PY_CALL_SYNTAX_RE', 1, False, None, r"""(?x)
[A-Za-z_][A-Za-z0-9_]{0,64}\s{0,8}\(
"""),
    ('PY_STMT_STRUCTURE_RE', 1, False, None, r"""(?mx)
(?:
    \n[ \t]+\S
  | ;\s*[A-Za-z_]                                  # a=1; b=2
  | ^\s*(?:if|for|while|def|class|try|except|
          finally|with|elif|else)\b[^\n]*:
)
"""),
    ('PY_IMPORT_STMT_RE', 2, True, None, r"""(?mx)
^\s*(?:
    import\s+[A-Za-z_][\w.]*
  | from\s+[A-Za-z_][\w.]*\s+import\s+
)
"""),
    ('PY_RISKY_MODULE_ATTR_RE', 2, False, None, r"""(?x)
\b(?:os|sys|socket|subprocess|shutil|ctypes|marshal|
     pickle|dill|base64|codecs|binascii|pty|platform|
     tempfile|glob|urllib|requests|http|ftplib|telnetlib|
     smtplib|threading|multiprocessing|signal|resource)
\s*\.\s*[A-Za-z_]
"""),
    ('PY_INDIRECTION_RE', 3, True, None, r"""(?x)
(?:
    \bgetattr\s*\([^)]{0,120}\bgetattr\s*\(
  | \bgetattr\s*\(\s*__import__\s*\(
  | \bvars\s*\(\s*\)\s*\[
  | \bglobals\s*\(\s*\)\s*\[
  | \bbuiltins\s*\.\s*__dict__\s*\[
)
"""),
    ('PY_CHAR_OBFUSCATION_RE', 3, True, None, r"""(?x)
(?:
    \bchr\s*\(\s*\d+\s*\)\s*\+                     # chr(104)+chr(105)
  | ['"]\s*\.\s*join\s*\(\s*\[?\s*chr\s*\(
  | \[\s*::\s*-\s*1\s*\]                           # "dmc"[::-1]
  | \bbytes\s*\(\s*\[\s*\d+\s*,\s*\d+
  | (?:\\x[0-9a-fA-F]{2}){6,}                      # \x68\x65\x6c...
  | (?:\\[0-7]{3}){6,}
)
"""),
    ('PY_ENCODED_PAYLOAD_RE', 2, True, None, r"""(?ix)
(?:
    base64\s*\.\s*(?:b64decode|b32decode|b16decode|a85decode|decodebytes|decodestring)
  | binascii\s*\.\s*(?:a2b_base64|unhexlify)
  | bytes\s*\.\s*fromhex\s*\(
  | codecs\s*\.\s*decode\s*\(
  | \.\s*decode\s*\(\s*['"](?:base64|hex|rot13|zlib|bz2)
  | zlib\s*\.\s*decompress\s*\(
  | marshal\s*\.\s*loads?\s*\(
)
"""),
    ('PY_FILE_WRITE_RE', 2, False, None, r"""(?x)
\bopen\s*\([^)]{0,200}['"][rwax]?[wax]\+?b?['"]
"""),
    ('PY_ASSIGN_RE', 1, False, None, r"""(?x)
\b[A-Za-z_][A-Za-z0-9_]*\s*=(?!=)\s*\S
"""),
    ('PY_INNER_STRING_RE', 1, False, None, r"""(?x)
(?:'[^']{4,}'|"[^"]{4,}")
"""),
    ('PY_LAMBDA_RE', 3, True, None, r"""(?x)
\blambda\b\s{0,8}[\w, ]{0,128}:
"""),
    ('PY_CODE_STRING_RE', 2, False, None, r"""(?x)
[A-Za-z_]\w{0,64}\s{0,8}\([^()]{0,500}\)
"""),
]

# Thresholds.
SHELL_DETECTION = {'min_len': 12, 'score_threshold': 2, 'meets_condition_ent_threshold': 5.0}
PYTHON_DETECTION = {'min_len': 6, 'score_threshold': 2}
CONTENT_SIGNALS = {'binary_non_ascii_threshold': 0.3, 'binary_min_len': 64, 'non_ascii_meta_cutoff': 0.2, 'literal_scan_max_len': 16384}
BYTES_DETECTION = {'min_size': 16, 'entropy_threshold': 6.0}

# Callables that are hits when invoked.
DENYLIST = [
    'os.system',
    'os.popen',
    'os.execv',
    'os.execve',
    'os.execvp',
    'os.execvpe',
    'subprocess.run',
    'subprocess.call',
    'subprocess.check_call',
    'subprocess.check_output',
    'subprocess.Popen',
    'eval',
    'exec',
    'compile',
    '__import__',
    'builtins.eval',
    'builtins.exec',
    'builtins.__import__',
    'commands.getoutput',
    'commands.getstatusoutput',
    'pty.spawn',
    '__builtin__.eval',
    '__builtin__.exec',
    '__builtin__.execfile',
    '__builtin__.compile',
    '__builtin__.__import__',
    '__builtin__.open',
    'importlib.import_module',
    'importlib._bootstrap._find_and_load',
    'runpy._run_code',
    'runpy.run_module',
    'runpy.run_path',
    'pickle.load',
    'dill.loads',
    'dill.load',
    'shelve.open',
    'jsonpickle.decode',
    'pandas.read_pickle',
    'marshal.load',
    'urllib.request.urlopen',
    'urllib.request.urlretrieve',
    'urllib.request.URLopener',
    'six.moves.urllib.request.urlopen',
    'telnetlib.Telnet',
    'ftplib.FTP',
    'xmlrpc.client.ServerProxy',
    'xmlrpc.client.Server',
    'asyncio.unix_events._UnixSubprocessTransport',
    'distutils.spawn.spawn',
    'cProfile.run',
    'cProfile.runctx',
    'cProfile.Profile.run',
    'cProfile.Profile.runctx',
    'profile.run',
    'profile.runctx',
    'profile.Profile.run',
    'profile.Profile.runctx',
    'trace.Trace.run',
    'trace.Trace.runctx',
    'pydoc.pipepager',
    'pydoc.locate',
    'pydoc.safeimport',
    'pydoc.tempfilepager',
    'logging.config._install_handlers',
    'logging.config._resolve',
    'unittest.loader.TestLoader._get_module_from_name',
    'unittest.mock._importer',
    'numpy.f2py.capi_maps.getinit',
    'numpy.f2py.crackfortran.myeval',
    'numpy.f2py.crackfortran._eval_scalar',
    'numpy.distutils.exec_command._exec_command',
    'numpy.distutils.cpuinfo.getoutput',
    'numpy.distutils.cpuinfo.command_by_line',
    'numpy.distutils.misc_util.get_cmd',
    'sympy.sympify',
    'sympy.utilities.lambdify.lambdify',
    'sympy.parsing.sympy_parser.eval_expr',
    'code.InteractiveInterpreter.runcode',
    'idlelib.run.Executive.runcode',
    'idlelib.calltip.get_entity',
    'idlelib.autocomplete.AutoComplete.get_entity',
    'cgitb.lookup',
    'uuid._get_command_stdout',
    'dataclasses._create_fn',
    '_osx_support._read_output',
    'xml.etree.ElementTree.ElementTree.write',
    'xml.etree.ElementTree._serialize_xml',
    'xml.etree.ElementTree._serialize_html',
    'numpy.savetxt',
    'numpy.lib.npyio.savetxt',
    'numpy.save',
    'numpy.savez',
    'distutils.file_util.write_file',
    'distutils.file_util._copy_file_contents',
    'distutils.tests.support.TempdirManager.write_file',
    'test.support.script_helper.make_script',
    'tracemalloc.Snapshot.dump',
    'profile.Profile.dump_stats',
    'pipes.Template.open_w',
    'http.cookiejar.LWPCookieJar.save',
    'mailbox._create_carefully',
    'urllib.request.URLopener.open',
    'urllib.request.URLopener.retrieve',
    'urllib.request.FileHandler.open_local_file',
    'argparse.FileType.__call__',
    'xml.dom.pulldom.parse',
    'xml.sax.saxutils.prepare_input_source',
    'xml.etree.ElementInclude.default_loader',
    'numpy.memmap',
    'numpy.load',
    'numpy.loadtxt',
    'numpy.lib.npyio.loadtxt',
    'numpy.ma.mrecords.openfile',
    'numpy.distutils.conv_template.resolve_includes',
    'pandas.io.common.get_handle',
    'pandas.io.parsers.readers.read_csv',
    'pandas.io.parsers.readers.read_table',
    'pandas.io.parsers.readers.read_fwf',
    'pandas.read_csv',
    'pandas.read_table',
    'pandas.read_pickle',
    'pipes.Template.open_r',
    'shlex.shlex.sourcehook',
    'mailbox.MH.get_bytes',
    'mailbox.MH.get_file',
    'pydoc._url_handler',
    'pkgutil.ImpLoader.get_data',
]

BYTES_DENYLIST = [
    'zlib.decompress',
    'zlib.decompress_obj',
    'pickle.loads',
    'pickle.load',
    '_pickle.loads',
    'marshal.loads',
    'marshal.load',
    'dill.loads',
    'dill.load',
    'base64.b64decode',
    'base64.decodebytes',
    'base64.decodestring',
    'binascii.a2b_base64',
    'codecs.decode',
    'numpy.load',
]

# Indicators. name or tag, benign count, category, subcategory.
LITERAL_STANDALONE = [
    ('pickle_magic', 0, 'Code Execution', 'Nested Pickle Execution'),
    ('pickle_magic_p0', 0, 'Code Execution', 'Nested Pickle Execution'),
    ('has_shell_pattern', 0, 'Code Execution', 'OS Command Execution'),
    ('has_path_traversal', 0, 'File System Access', 'Path Traversal'),
]

LITERAL_COMBINATION = [
    ('has_url', 2, 'Network Connection', 'Embedded URL Literal'),
    ('has_python_code', 190, None, None),
    ('has_path', 197, None, None),
    ('has_windows_path', 47, None, None),
    ('entropy>=', 2, None, None),
]

LITERAL_DISQUALIFIED = [
    'has_shell_substitution',
    'entropy_binary_data',
    'literal_truncated',
]

CALLABLE_STANDALONE = [
    ('builtins.eval', 0, 'Code Execution', 'Dynamic Code Execution'),
    ('builtins.exec', 0, 'Code Execution', 'Dynamic Code Execution'),
    ('builtins.compile', 0, 'Code Execution', 'Dynamic Code Execution'),
    ('builtins.__import__', 0, 'Code Execution', 'Dynamic Module Import'),
    ('importlib.import_module', 0, 'Code Execution', 'Dynamic Module Import'),
    ('os.system', 0, 'Code Execution', 'OS Command Execution'),
    ('os.popen', 0, 'Code Execution', 'OS Command Execution'),
    ('subprocess.Popen', 0, 'Code Execution', 'Process Spawning'),
    ('subprocess.run', 0, 'Code Execution', 'Process Spawning'),
    ('subprocess.getoutput', 0, 'Code Execution', 'OS Command Execution'),
    ('pty.spawn', 0, 'Code Execution', 'Process Spawning'),
    ('pickle.loads', 0, 'Code Execution', 'Nested Pickle Execution'),
    ('webbrowser.open', 0, 'Network Connection', 'Forced URL Access'),
    ('requests.api.get', 0, 'Network Connection', 'Network beaconing'),
    ('urllib.request.urlopen', 0, 'Network Connection', 'Forced URL Access'),
    ('pydoc.importfile', 0, 'Code Execution', 'Module Load from Path'),
    ('numpy.distutils.misc_util.exec_mod_from_location', 0, 'Code Execution', 'Module Load from Path'),
    ('dataclasses._create_fn', 0, 'Code Execution', 'Dynamic Code Execution'),
    ('pydoc._url_handler', 0, 'Code Execution', 'Dynamic Code Execution'),
    ('numpy.distutils.cpuinfo.command_info', 0, 'Code Execution', 'OS Command Execution'),
    ('numpy.distutils.lib2def.getnm', 0, 'Code Execution', 'OS Command Execution'),
    ('numpy.f2py.f2py2e.callcrackfortran', 0, 'File Operation', 'Arbitrary File Write'),
    ('numpy.distutils.command.build_src.subst_vars', 0, 'File Operation', 'Arbitrary File Write'),
    ('numpy.core._methods._dump', 0, 'File Operation', 'Arbitrary File Write'),
    ('sympy.utilities._compilation.compilation._write_sources_to_build_dir', 0, 'File Operation', 'Arbitrary File Write'),
    ('pandas.io.formats.format._get_buffer', 0, 'File Operation', 'Arbitrary File Write'),
    ('uu.decode', 0, 'File Operation', 'Arbitrary File Write'),
    ('_pyio._open_code_with_warning', 0, 'File Operation', 'Arbitrary File Read'),
    ('doctest._load_testfile', 0, 'File Operation', 'Arbitrary File Read'),
    ('fileinput.hook_compressed', 0, 'File Operation', 'Arbitrary File Read'),
    ('numpy.compat.py3k.open_latin1', 0, 'File Operation', 'Arbitrary File Read'),
    ('numpy.f2py.crackfortran.openhook', 0, 'File Operation', 'Arbitrary File Read'),
    ('numpy.distutils.from_template.resolve_includes', 0, 'File Operation', 'Arbitrary File Read'),
    ('numpy.f2py._src_pyf.resolve_includes', 0, 'File Operation', 'Arbitrary File Read'),
    ('pandas.io.parsers.read_fwf', 0, 'File Operation', 'Arbitrary File Read'),
    ('pandas.io.common._maybe_memory_map', 0, 'File Operation', 'Arbitrary File Read'),
    ('sympy.physics.quantum.qasm.read_qasm_file', 0, 'File Operation', 'Arbitrary File Read'),
    ('sympy.utilities.pkgdata.get_resource', 0, 'File Operation', 'Arbitrary File Read'),
    ('turtle.config_dict', 0, 'File Operation', 'Arbitrary File Read'),
    ('joblib.numpy_pickle.dump', 0, 'File Operation', 'Arbitrary File Write'),
    ('torch._inductor.codecache.touch', 0, 'File Operation', 'Arbitrary File Write'),
    ('torch.cuda.memory._save_segment_usage', 0, 'File Operation', 'Arbitrary File Write'),
    ('torch.utils.cpp_extension._maybe_write', 0, 'File Operation', 'Arbitrary File Write'),
    ('torch.utils.collect_env.run', 0, 'Code Execution', 'Process Spawning'),
    ('lib2to3.refactor.RefactoringTool._read_python_source', 0, 'File Operation', 'Arbitrary File Read'),
    ('lib2to3.tests.test_refactor.TestRefactoringTool.read_file', 0, 'File Operation', 'Arbitrary File Read'),
    ('numpy.core.tests.test_multiarray.TestIO._check_from', 0, 'File Operation', 'Arbitrary File Read'),
    ('tracemalloc.Snapshot.dump', 0, 'File Operation', 'Arbitrary File Write'),
    ('pandas.core.series.Series.to_string', 0, 'File Operation', 'Arbitrary File Write'),
    ('numpy._core._methods._dump', 0, 'File Operation', 'Arbitrary File Write'),
    ('_pydev_bundle._pydev_execfile.execfile', 0, 'Code Execution', 'Dynamic Code Execution'),
]

CALLABLE_COMBINATION = [
    ('sys.exit', 0, 'Denial of Service', 'Process Termination'),
    ('test.support.get_attribute', 0, 'Code Execution', 'Attribute Indirection Gadget'),
    ('unittest.mock._dot_lookup', 0, 'Code Execution', 'Attribute Indirection Gadget'),
    ('xmlrpc.server.resolve_dotted_attribute', 0, 'Code Execution', 'Attribute Indirection Gadget'),
    ('lib2to3.fixer_util.attr_chain', 0, 'Code Execution', 'Attribute Indirection Gadget'),
    ('builtins.getattr', 162, 'Code Execution', 'Attribute Indirection Gadget'),
    ('operator.getitem', 4, 'Code Execution', 'Builtins Dictionary Gadget'),
    ('operator.attrgetter', 0, 'Code Execution', 'Attribute Indirection Gadget'),
    ('io.BytesIO', 0, 'Code Execution', 'BytesIO Load Chain'),
    ('codecs.encode', 16, None, None),
    ('dill._dill._load_type', 9, None, None),
    ('builtins.dict', 6, None, None),
    ('builtins.int', 13, None, None),
]

DANGEROUS_NAMES = [
    '__builtins__',
    '__globals__',
    '__reduce__',
    '__class__',
    '__subclasses__',
    '__import__',
    'system',
    'popen',
    'eval',
    'exec',
    'compile',
    'spawn',
]

# Label of a gateway callable, first match wins; the last is the fallback.
GATEWAY_NAMING = [
    (r"""(?:^|\.)(?:system|popen|getoutput|getstatusoutput|command_by_line|_exec_command|_read_output|_get_command_stdout)$""", 'Code Execution', 'OS Command Execution'),
    (r"""(?:^|\.)(?:spawn|Popen|run|call|check_call|check_output|runctx|runcode|execv|execve|execvp|execvpe|pipepager|tempfilepager)$""", 'Code Execution', 'Process Spawning'),
    (r"""(?:^|\.)(?:eval|exec|execfile|compile|myeval|_eval_scalar|sympify|lambdify|eval_expr|_create_fn|_run_code|run_module|run_path)$""", 'Code Execution', 'Dynamic Code Execution'),
    (r"""(?:^|\.)(?:__import__|import_module|safeimport|locate|_find_and_load|_get_module_from_name|_importer|get_entity|lookup)$""", 'Code Execution', 'Dynamic Module Import'),
    (r"""(?:^|\.)(?:urlopen|urlretrieve|URLopener|Telnet|FTP|ServerProxy|Server)$""", 'Network Connection', 'Remote Resource Access'),
    (r"""(?:^|\.)(?:save|savez|savetxt|dump|dump_stats|write|write_file|_copy_file_contents|make_script|open_w|_create_carefully|retrieve|_serialize_xml|_serialize_html|__call__)$""", 'File Operation', 'Arbitrary File Write'),
    (r"""(?:^|\.)(?:load|loads|decode|read_pickle|read_csv|read_table|read_fwf|loadtxt|memmap|openfile|open|open_local_file|open_r|get_handle|get_bytes|get_file|get_data|sourcehook|parse|prepare_input_source|default_loader|resolve_includes|_url_handler)$""", 'File Operation', 'Arbitrary File Read'),
]

# Strings of the behaviour rules. rule: tier, category, subcategory, priority, evidence, {name: (pattern, any case)}.
BEHAVIOURS = {
    'NativeCodeLoading': ('labeling', 'Code Execution', 'Native Library Loading', 1, {
        'ctypes_kw': (r'''\bctypes\b''', True),
        'cdll_kw': (r'''\bCDLL\b''', True),
        'so_path': (r'''[A-Za-z0-9_.+-]{1,128}\.so(\.[0-9]{1,3})?\b''', True),
        'dll_path': (r'''[A-Za-z0-9_.+-]{1,128}\.dll\b''', True),
        'dylib_p': (r'''[A-Za-z0-9_.+-]{1,128}\.dylib\b''', True),
    }),
    'DynamicModuleImport': ('labeling', 'Code Execution', 'Dynamic Module Import', 1, {
        'import_mod': (r'''\bimport_module\b''', True),
    }),
    'ExecutionByOsSystem': ('labeling', 'Code Execution', 'OS Command Execution', 1, {
        'os_sys': (r'''\bos\.system\b''', True),
        'os_popen': (r'''\bos\.popen\b''', True),
        'os_execv': (r'''\bos\.exec''', True),
    }),
    'ExecutionBySubprocess': ('labeling', 'Code Execution', 'Process Spawning', 1, {
        'sub_run': (r'''\bsubprocess\.run\b''', True),
        'sub_popen': (r'''\bsubprocess\.Popen\b''', True),
        'sub_call': (r'''\bsubprocess\.call\b''', True),
        'sub_co': (r'''\bsubprocess\.check_output\b''', True),
        'sub_cc': (r'''\bsubprocess\.check_call\b''', True),
    }),
    'ExecutionByEvalExec': ('labeling', 'Code Execution', 'Dynamic Code Execution', 1, {
        'eval_kw': (r'''^eval[\s\x00]''', False),
        'exec_kw': (r'''^exec[\s\x00]''', False),
        'compile_kw': (r'''^compile[\s\x00]''', False),
        'import_kw': (r'''^__import__[\s\x00]''', False),
        'b_eval': (r'''^builtins\.eval[\s\x00]''', False),
        'b_exec': (r'''^builtins\.exec[\s\x00]''', False),
        'b_import': (r'''^builtins\.__import__[\s\x00]''', False),
    }),
    'ZlibObfuscatedExec': ('standalone', 'Code Execution', 'Zlib-Obfuscated Execution', 1, {
        'zlib_dc': (r'''\bzlib\.decompress\b''', True),
        'binbytes': (r'''\[BINBYTES:''', False),
        'fmt_zlib': (r'''fmt=zlib_magic''', False),
    }),
    'NestedPickleExecution': ('standalone', 'Code Execution', 'Nested Pickle Execution', 1, {
        'pkl_loads': (r'''\b_?pickle\.loads\b''', True),
        'fmt_pickle': (r'''fmt=pickle_magic''', True),
    }),
    'BytesIOLoadChain': ('standalone', 'Code Execution', 'BytesIO Load Chain', 1, {
        'numpy_load': (r'''\bnumpy\.load\b''', True),
        'pkl_load': (r'''\bpickle\.load\b''', True),
        'binbytes': (r'''\[BINBYTES:''', False),
    }),
    'MarshalObfuscation': ('standalone', 'Code Execution', 'Marshal Bytecode Execution', 1, {
        'marshal_l': (r'''\bmarshal\.loads\b''', True),
        'binbytes': (r'''\[BINBYTES:''', False),
    }),
    'ExecutionByRunpy': ('labeling', 'Code Execution', 'Dynamic Script Execution', 1, {
        'runpy_rc': (r'''\brunpy\._run_code\b''', True),
        'runpy_rm': (r'''\brunpy\.run_module\b''', True),
        'runpy_rp': (r'''\brunpy\.run_path\b''', True),
    }),
    'TraceHookEvasion': ('labeling', 'Code Execution', 'Trace Hook Evasion', 1, {
        'settrace': (r'''\bsys\.settrace\b''', True),
        'setprofile': (r'''\bsys\.setprofile\b''', True),
        'gettrace': (r'''\bsys\.gettrace\b''', True),
    }),
    'SteganographicPayload': ('standalone', 'Code Execution', 'Steganographic Payload', 1, {
        'stego_kw': (r'''\bstego_decode\b''', True),
        'lsb_kw': (r'''\bLSB\b|\blsb_extract\b''', True),
        'exec_dec': (r'''exec\s*\(\s*\S+\.decode\s*\(''', True),
    }),
    'NetworkReverseShell': ('labeling', 'Network Connection', 'Reverse Shell', 1, {
        'platform': (r'''from\s+sys\s+import\s+platform''', True),
        'bin_sh': (r'''/bin/sh''', True),
        'bash_i': (r'''bash\s+-i''', True),
        'sh_i': (r'''sh\s+-i''', True),
        'devtcp': (r'''/dev/tcp/''', True),
        'nc_e': (r'''(nc|netcat)\s+\S+\s+-e\s+''', True),
        'redir_01': (r'''0>\&1''', False),
        'redir_10': (r'''1>\&0''', False),
    }),
    'NetworkForcedURLAccess': ('labeling', 'Network Connection', 'Forced URL Access', 1, {
        'urlopen_1': (r'''request\.urlopen''', True),
        'urlopen_2': (r'''urllib\.request\.urlopen''', True),
        'wb_open': (r'''webbrowser\.open''', True),
    }),
    'NetworkBeaconing': ('labeling', 'Network Connection', 'Network beaconing', 1, {
        'http': (r'''https?://[^\s'"<>]+''', True),
        'ip': (r'''\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b''', False),
        'socket_kw': (r'''\bsocket\b''', True),
        'req_kw': (r'''\brequests?\b|\burllib\b''', True),
    }),
    'FileOperationPseudoRansomware': ('standalone', 'File Operation', 'Pseudo-ransomware', 2, {
        'open_call': (r'''\bopen\s*\(''', True),
        'crypto_kw': (r'''\bcrypto\b|\bcryptography\b|\bfernet\b|\bAES\b|\bRSA\b''', True),
        'os_walk': (r'''\bos\.walk\b''', True),
    }),
    'FileOperationDropping': ('standalone', 'File Operation', 'File Dropping', 2, {
        'open_call': (r'''\bopen\s*\(''', True),
        'write_call': (r'''\bwrite\s*\(''', True),
        'close_call': (r'''\bclose\s*\(''', True),
    }),
    'BuiltinsDictGadget': ('standalone', 'Code Execution', 'Builtins Dictionary Gadget', 1, {
        'b_name': (r'''__(builtins|builtin|globals)__''', False),
        'b_getitem': (r'''(operator\.)?getitem''', True),
        'b_subscr': (r'''__(builtins|builtin|globals)__[ ]*\[''', False),
        'tag_esc': (r'''PY_SANDBOX_ESCAPE_CHAIN_RE''', False),
    }),
    'ObfuscationBase64': ('labeling', 'Obfuscation', 'Code Obfuscation (base64)', 3, {
        'b64_kw': (r'''\bbase64\b|b64decode|b64encode''', True),
        'b64_blob': (r'''(^|[^A-Za-z0-9+/=])([A-Za-z0-9+]{40,}|[A-Za-z0-9+]{16,}/[A-Za-z0-9+]{16,}(/[A-Za-z0-9+]{16,}){0,2})={0,2}([^A-Za-z0-9+/=]|$)''', False),
        'tag_path': (r'''has_path''', False),
        'tag_winpath': (r'''has_windows_path''', False),
    }),
    'ObfuscationZlib': ('labeling', 'Obfuscation', 'Code Obfuscation (Zlip)', 3, {
        'zlib_kw': (r'''\bzlib\b|decompress\s*\(''', True),
    }),
    'ObfuscationHighEntropy': ('labeling', 'Obfuscation', 'Code Obfuscation', 3, {
        'ent_text': (r'''entropy>=[0-9]+\.[0-9]''', False),
        'ent_binary': (r'''entropy_binary_data''', False),
        'tag_path': (r'''has_path''', False),
        'tag_winpath': (r'''has_windows_path''', False),
    }),
    'ObfuscationHighEntropyConfirmed': ('standalone', 'Obfuscation', 'Code Obfuscation (high confidence)', 3, {
        'ent_text': (r'''entropy>=[0-9]+\.[0-9]''', False),
        'exec_kw': (r'''\b(exec|eval|compile|__import__)\b''', True),
        'decode_kw': (r'''\b(decode|decompress|b64decode)\b''', True),
        'tag_path': (r'''has_path''', False),
        'tag_winpath': (r'''has_windows_path''', False),
    }),
    'ObfuscationCharEncoding': ('labeling', 'Obfuscation', 'Character Encoding Obfuscation', 3, {
        'hex_seq': (r'''\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}\\x[0-9a-fA-F]{2}''', False),
        'chr_join': (r'''['"]{1}\.join\s*\(\s*chr\s*\(''', False),
        'chr_concat': (r'''chr\s*\(\s*\d+\s*\)\s*\+\s*chr\s*\(''', False),
        'getattr_b': (r'''getattr\s*\(\s*__builtins__''', False),
    }),
    'ObfuscationAPIIndirection': ('labeling', 'Obfuscation', 'API Indirection Obfuscation', 3, {
        'dict_acc': (r'''__dict__\s*\[''', False),
        'getattrib': (r'''__getattribute__\s*\(''', False),
        'dunder_imp': (r'''__import__\s*\(\s*["'][^"']{1,32}["']\s*\)''', False),
    }),
    'ExfiltrateSensitiveData': ('standalone', 'Network Connection', 'Sensitive Data Exfiltration', 1, {
        'env_read': (r'''os\.environ''', False),
        'getenv': (r'''os\.getenv\s*\(''', False),
        'aws_cred': (r'''\.aws/credentials''', False),
        'ssh_key': (r'''\.ssh[/\\](id_rsa|authorized_keys)''', False),
        'req_post': (r'''requests\.(post|put|patch)\s*\(''', True),
        'urllib_op': (r'''urllib\.request\.urlopen\s*\(''', False),
        'sock_send': (r'''\.(sendall|sendto)\s*\(''', False),
    }),
    'DownloadAndExecute': ('standalone', 'Code Execution', 'Remote Download and Execute', 1, {
        'urlretr': (r'''urllib\.request\.urlretrieve\s*\(''', False),
        'req_get': (r'''requests\.get\s*\(''', False),
        'urlopen': (r'''urlopen\s*\(''', False),
        'chmod_x': (r'''os\.chmod\s*\(.{1,60}0o?[67][57][57]''', False),
        'exec_sub': (r'''subprocess\.(run|Popen|call)\s*\(''', False),
        'exec_os': (r'''os\.(system|execv)\s*\(''', False),
    }),
    'SilentProcessExecution': ('standalone', 'Code Execution', 'Silent Process Execution', 1, {
        'sub_func': (r'''subprocess\.(run|Popen|call|check_call|check_output)\s*\(''', False),
        'devnull': (r'''DEVNULL''', False),
        'stdout_dn': (r'''stdout\s*=\s*subprocess\.DEVNULL''', False),
        'stderr_dn': (r'''stderr\s*=\s*subprocess\.DEVNULL''', False),
    }),
    'ShadyExternalDomain': ('labeling', 'Network Connection', 'Suspicious External Domain', 1, {
        'ngrok': (r'''ngrok\.io''', True),
        'webhook': (r'''webhook\.site''', True),
        'burp': (r'''burpcollaborator''', True),
        'discord': (r'''discord\.com/api''', True),
        'pastebin': (r'''pastebin\.com''', True),
        'transfer': (r'''transfer\.sh''', True),
        'catbox': (r'''catbox\.moe''', True),
        'ipinfo': (r'''ipinfo\.io''', True),
        'ifconfig': (r'''ifconfig\.me''', True),
        'telegram': (r'''api\.telegram\.org''', True),
    }),
    'WeakDeserializationAlternative': ('labeling', 'Code Execution', 'Alternative Deserialization', 1, {
        'dill_l': (r'''\bdill\.loads?\b''', True),
        'shelve_o': (r'''\bshelve\.open\b''', True),
        'jpickle': (r'''\bjsonpickle\.decode\b''', True),
        'pd_pickle': (r'''\bpandas\.read_pickle\b''', True),
        'marshal_l': (r'''\bmarshal\.load\b''', True),
    }),
    'ClipboardScreenCapture': ('labeling', 'Network Connection', 'User Surveillance', 1, {
        'pyperclip': (r'''pyperclip\.(paste|copy)\s*\(''', True),
        'imgrab': (r'''ImageGrab\.grab\s*\(''', True),
        'pyscrsht': (r'''pyscreenshot''', True),
        'pyautogui': (r'''pyautogui\.screenshot\s*\(''', True),
        'mss_cap': (r'''mss\.mss\s*\(\)''', True),
    }),
    'GTFOBinUnixExec': ('labeling', 'Code Execution', 'GTFOBins Unix Proxy Execution', 1, {
        'awk_sys': (r'''\bawk\b.{0,300}BEGIN\s*\{.{0,300}system\s*\(''', True),
        'xargs_sh': (r'''\bxargs\b.{0,200}-[Ii]\b.{0,200}(bash|sh)\s+-c''', True),
        'vim_exec': (r'''\bvi(m)?\b.{0,300}(-c\s+.{0,10}:!|:system\s*\()''', True),
        'nmap_scr': (r'''\bnmap\b.{0,400}(--script-exec|--script\s*=)''', True),
        'env_sh': (r'''\benv\b.{0,50}(bash|sh|python|perl)\s+-[ci]''', True),
    }),
    'LOLBASWindowsScriptHost': ('standalone', 'Code Execution', 'Windows Script Host Execution', 1, {
        'wscript': (r'''\bwscript(\.exe)?\b''', True),
        'cscript': (r'''\bcscript(\.exe)?\b''', True),
        'vbs': (r'''\.(vbs|js|jse|vbe|wsf)\b''', True),
        'engine': (r'''(//e:|//engine:)(jscript|vbscript)''', True),
    }),
    'LOLBASMshtaExec': ('standalone', 'Code Execution', 'MSHTA HTA Execution', 1, {
        'mshta': (r'''\bmshta(\.exe)?\b''', True),
        'vbs_url': (r'''vbscript:''', True),
        'js_url': (r'''javascript:''', True),
        'hta_url': (r'''https?://[^\s"']{4,}\.hta\b''', True),
    }),
    'LOLBASNetAssemblyExec': ('standalone', 'Code Execution', '.NET Assembly Proxy Execution', 1, {
        'installutil': (r'''\bInstallUtil(\.exe)?\b''', True),
        'regasm': (r'''\bregasm(\.exe)?\b''', True),
        'regsvcs': (r'''\bregsvcs(\.exe)?\b''', True),
        'uninstall': (r'''/(U|uninstall)\b''', True),
        'codebase': (r'''/codebase\b''', True),
    }),
    'LOLBASFileDownload': ('labeling', 'Network Connection', 'LOLBAS Uncommon Download', 1, {
        'deskdown': (r'''\bdesktopimgdownldr(\.exe)?\b.{0,200}/lockscreenurl:''', True),
        'esentutl': (r'''\besentutl(\.exe)?\b.{0,200}(/y|/vss)\b''', True),
        'ieexec': (r'''\bieexec(\.exe)?\b.{0,200}https?://''', True),
        'odbcconf': (r'''\bodbcconf(\.exe)?\b.{0,300}(REGSVR|/a\b)''', True),
        'forfiles_c': (r'''\bforfiles(\.exe)?\b.{0,400}/c\b.{0,200}cmd\b''', True),
    }),
    'ExecBase64TaintChain': ('standalone', 'Code Execution', 'Base64 Taint Chain Execution', 1, {
        'src_b64d': (r'''\bbase64\.b64decode\s*\(''', True),
        'src_str_dec': (r'''["']\.decode\s*\(\s*["'][^"']{1,32}["']\s*\)''', True),
        'src_codecs': (r'''\bcodecs\.decode\s*\(''', True),
        'src_import_b64': (r'''import_module\s*\(\s*['"]base64['"]\s*\)''', True),
        'src_marshal_z': (r'''\bmarshal\.loads\s*\(\s*\S*zlib\.decompress''', True),
        'sink_exec': (r'''\bexec\s*\(''', True),
        'sink_eval': (r'''\beval\s*\(''', True),
        'sink_sub_run': (r'''\bsubprocess\.(run|call|check_output|Popen)\s*\(''', True),
        'sink_os_sys': (r'''\bos\.(system|popen|execl|execv|spawnl|posix_spawn)\s*\(''', True),
    }),
    'PyArmorObfuscation': ('labeling', 'Obfuscation', 'PyArmor Obfuscation', 3, {
        'pyarmor_call': (r'''\b__pyarmor__\s*\(''', True),
        'pytransform': (r'''\bpytransform\b''', True),
        'runtime_call': (r'''\bpyarmor_runtime\b''', True),
        'runtime_import': (r'''pyarmor_runtime[_\w]*\s+import\s+__pyarmor__''', True),
        'armor_enter': (r'''__armor_enter__''', False),
        'armor_exit': (r'''__armor_exit__''', False),
        'pyarmor_enter': (r'''__pyarmor_enter__''', False),
        'pyarmor_exit': (r'''__pyarmor_exit__''', False),
        'check_armored': (r'''\bcheck_armored\s*\(''', True),
        'assert_armored': (r'''\bassert_armored\s*\(''', True),
    }),
    'DLLHijackingInjection': ('labeling', 'Code Execution', 'DLL Hijacking / Process Injection', 1, {
        'write_pm': (r'''WriteProcessMemory''', True),
        'create_rt': (r'''CreateRemoteThread''', True),
        'load_lib': (r'''LoadLibraryA''', True),
        'cdll_kw': (r'''\bCDLL\s*\(''', True),
        'ctypes_kw': (r'''\bctypes\b''', True),
        'ld_preload': (r'''LD_PRELOAD''', True),
        'lolbin_rundll': (r'''\brundll32(\.exe)?\b''', True),
        'lolbin_regsvr': (r'''\bregsvr32(\.exe)?\b''', True),
        'lolbin_msiexec': (r'''\bmsiexec(\.exe)?\b''', True),
        'lolbin_mshta': (r'''\bmshta(\.exe)?\b''', True),
        'lolbin_cmstp': (r'''\bcmstp(\.exe)?\b''', True),
        'lolbin_mavinj': (r'''\bmavinject(\.exe)?\b''', True),
        'wb_open': (r'''open\s*\(.{0,80}['"]wb['"]''', True),
    }),
    'SensitiveFileAccess': ('labeling', 'Network Connection', 'Sensitive File Access', 1, {
        'cli_passwd': (r'''(cat|less|more|head|tail)\s+.{0,100}/etc/passwd''', True),
        'open_passwd': (r'''open\s*\(\s*['"]/etc/passwd''', True),
        'read_passwd': (r'''(readFile|readFileSync)\s*\(\s*['"]/etc/passwd''', True),
        'shadow': (r'''/etc/shadow\b''', True),
        'sudoers': (r'''/etc/sudoers\b''', True),
    }),
    'AceGadget': ('labeling', 'Code Execution', 'ACE Gadget', 1, {
        'asyncio_sp': (r'''\basyncio(\.unix_events)?\._UnixSubprocessTransport\b''', True),
        'distspawn': (r'''\bdistutils\.spawn\.spawn\b''', True),
        'cprofile': (r'''\bcProfile\.(run|runctx)\b''', True),
        'cprofile_p': (r'''\bcProfile\.Profile\.(run|runctx)\b''', True),
        'profile_r': (r'''\bprofile\.(run|runctx)\b''', True),
        'profile_p': (r'''\bprofile\.Profile\.(run|runctx)\b''', True),
        'trace_run': (r'''\btrace\.Trace\.(run|runctx)\b''', True),
        'trace_wrf': (r'''\btrace\.CoverageResults\.write_results_file\b''', True),
        'pydoc_pp': (r'''\bpydoc\.(pipepager|locate|safeimport|tempfilepager)\b''', True),
        'logging_ih': (r'''\blogging\.config\.(_install_handlers|_resolve)\b''', True),
        'unittest_g': (r'''\bunittest\.loader\.TestLoader\._get_module_from_name\b''', True),
        'unittest_m': (r'''\bunittest\.mock\._importer\b''', True),
        'numpy_get': (r'''\bnumpy\.f2py\.capi_maps\.getinit\b''', True),
        'numpy_eval': (r'''\bnumpy\.f2py\.crackfortran\.(myeval|_eval_scalar)\b''', True),
        'numpy_exec': (r'''\bnumpy\.distutils\.(exec_command\._exec_command|cpuinfo\.getoutput|cpuinfo\.command_by_line|misc_util\.get_cmd)\b''', True),
        'sympy_sym': (r'''\bsympy\.(sympify|utilities\.lambdify\.lambdify|parsing\.sympy_parser\.eval_expr)\b''', True),
        'code_run': (r'''\bcode\.InteractiveInterpreter\.runcode\b''', True),
        'idlelib_r': (r'''\bidlelib\.(run\.Executive\.runcode|calltip\.get_entity|autocomplete\.AutoComplete\.get_entity)\b''', True),
        'misc_ace': (r'''\b(uuid\._get_command_stdout|_osx_support\._read_output|cgitb\.lookup|dataclasses\._create_fn)\b''', True),
    }),
    'AfwGadget': ('labeling', 'File Operation', 'Arbitrary File Write', 1, {
        'xml_write': (r'''\bxml\.etree\.ElementTree\.(ElementTree\.write|_serialize_xml|_serialize_html)\b''', True),
        'np_savetxt': (r'''\bnumpy\.(savetxt|save|savez|lib\.npyio\.savetxt)\b''', True),
        'dist_write': (r'''\bdistutils\.(file_util\.(write_file|_copy_file_contents)|tests\.support\.TempdirManager\.write_file)\b''', True),
        'test_make': (r'''\btest\.support\.script_helper\.make_script\b''', True),
        'prof_dump': (r'''\b(tracemalloc\.Snapshot\.dump|profile\.Profile\.dump_stats)\b''', True),
        'pipes_mbox': (r'''\b(pipes\.Template\.open_w|mailbox\._create_carefully)\b''', True),
        'http_save': (r'''\bhttp\.cookiejar\.LWPCookieJar\.save\b''', True),
    }),
    'AfrGadget': ('labeling', 'File Operation', 'Arbitrary File Read', 1, {
        'urllib_op': (r'''\burllib\.request\.(URLopener\.(open|retrieve)|FileHandler\.open_local_file)\b''', True),
        'xml_parse': (r'''\bxml\.(dom\.pulldom\.parse|sax\.saxutils\.prepare_input_source|etree\.ElementInclude\.default_loader)\b''', True),
        'np_load': (r'''\bnumpy\.(memmap|load|loadtxt|lib\.npyio\.loadtxt|ma\.mrecords\.openfile|distutils\.conv_template\.resolve_includes)\b''', True),
        'pd_read': (r'''\bpandas\.(read_csv|read_table|read_fwf|read_pickle|io\.(parsers\.readers\.(read_csv|read_table|read_fwf)|common\.get_handle))\b''', True),
        'argparse_f': (r'''\bargparse\.FileType\.__call__\b''', True),
        'misc_read': (r'''\b(pipes\.Template\.open_r|shlex\.shlex\.sourcehook|mailbox\.MH\.(get_bytes|get_file)|pkgutil\.ImpLoader\.get_data)\b''', True),
        'pydoc_url': (r'''\bpydoc\._url_handler\b''', True),
    }),
}
