"""A text that fires each behaviour rule, all the rules that it fires, and a text that just fails to."""

from __future__ import annotations

_DENSE = "[TAGS: entropy>=5.5] !#$%&()*+,-.0123456789:;<=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ^_`abcdefghijklmnopqrstuvwxyz{|}~"

#: rule -> (text that fires it, further rules that the text fires, text that doesn't fire it)
RULE_TEXTS: dict[str, tuple[str, list[str], str]] = {
    "NativeCodeLoading": ("load libfoo.so now", [], "load libfoo.soap now"),
    "DynamicModuleImport": ("importlib.import_module x", [], "importlib.import_modules x"),
    "ExecutionByOsSystem": ("os.system id", [], "os.systems id"),
    "ExecutionBySubprocess": ("subprocess.run ls", [], "subprocess.runs ls"),
    "ExecutionByEvalExec": ("builtins.eval 1+1", [], "m.X builtins.eval 1+1"),
    "ZlibObfuscatedExec": ("zlib.decompress [BINBYTES:789c len=9 fmt=zlib_magic]", ["ObfuscationZlib"], "zlib.decompress BINBYTES"),
    "NestedPickleExecution": ("pickle.loads [BINBYTES:8004 len=9 fmt=pickle_magic]", [], "pickle.loads [BINBYTES:0000 len=9 fmt=]"),
    "BytesIOLoadChain": ("numpy.load [BINBYTES:0000 len=9 fmt=]", ["AfrGadget"], "numpy.load BINBYTES"),
    "MarshalObfuscation": ("marshal.loads [BINBYTES:e300 len=9 fmt=]", [], "marshal.loads e300"),
    "ExecutionByRunpy": ("runpy.run_path x.py", [], "runpy.run_paths x.py"),
    "TraceHookEvasion": ("sys.settrace f", [], "sys.settracer f"),
    "SteganographicPayload": ("stego_decode(img); exec(x.decode(1))", [], "stego_decode(img); exec(x)"),
    "NetworkReverseShell": ("bash -i to sh 0>&1", [], "bash -c to sh 0>&1"),
    "NetworkForcedURLAccess": ("webbrowser.open now", [], "browser.open now"),
    "NetworkBeaconing": ("see https://a.example/x", [], "see https: a.example"),
    "FileOperationPseudoRansomware": ("os.walk d open (f) fernet", [], "os.walk d open f fernet"),
    "FileOperationDropping": ("open(f).write(x)", [], "open(f).written x"),
    "BuiltinsDictGadget": ("__globals__ [0]", [], "__globals__ 0"),
    "ObfuscationBase64": ("b64decode x", [], "b64decode x has_path"),
    "ObfuscationZlib": ("zlib stuff", [], "zlibs stuff"),
    "ObfuscationHighEntropy": (_DENSE, [], _DENSE + " entropy_binary_data"),
    "ObfuscationHighEntropyConfirmed": (_DENSE + " exec", ["ObfuscationHighEntropy"], _DENSE + " has_path exec"),
    "ObfuscationCharEncoding": (r"say \x41\x42\x43", [], r"say \x41\x42"),
    "ObfuscationAPIIndirection": ("a.__dict__ [0]", [], "a.__dict__"),
    "ExfiltrateSensitiveData": ("os.environ requests.post(u)", ["NetworkBeaconing"], "os.environ requests.post u"),
    "DownloadAndExecute": ("requests.get(u) os.system(c)", ["ExecutionByOsSystem", "NetworkBeaconing"], "requests.get(u) os.sys(c)"),
    "SilentProcessExecution": ("subprocess.run(c, stdout=subprocess.DEVNULL)", ["ExecutionBySubprocess"], "subprocess.run(c, DEVNULL)"),
    "ShadyExternalDomain": ("x.ngrok.io", [], "x.ngrok.oi"),
    "WeakDeserializationAlternative": ("dill.loads x", [], "dill.loader x"),
    "ClipboardScreenCapture": ("pyperclip.paste()", [], "pyperclip.pasted"),
    "GTFOBinUnixExec": ("env bash -c id", [], "env bash id"),
    "LOLBASWindowsScriptHost": ("wscript a.vbs", [], "wscript a.txt"),
    "LOLBASMshtaExec": ("mshta javascript:x", [], "mshta javascript x"),
    "LOLBASNetAssemblyExec": ("regasm /U x", [], "regasm x"),
    "LOLBASFileDownload": ("forfiles /c cmd", [], "forfiles /d cmd"),
    "ExecBase64TaintChain": ("exec(codecs.decode(x))", [], "execs codecs.decode(x)"),
    "PyArmorObfuscation": ("a pytransform b", [], "a pytransforms b"),
    "DLLHijackingInjection": ("LD_PRELOAD", [], "LD_RELOAD"),
    "SensitiveFileAccess": ("read /etc/shadow", [], "read /etc/shadows"),
    "AceGadget": ("cProfile.run x", [], "cProfile.runs x"),
    "AfwGadget": ("numpy.savetxt x", [], "numpy.saver x"),
    "AfrGadget": ("argparse.FileType.__call__ x", [], "argparse.FileType x"),
}
