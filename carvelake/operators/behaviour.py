"""Behaviour rules: one boolean column for each rule over a hit's text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carvelake.functions import fixed_values as V
from carvelake.functions.pattern_index import candidates, may_match
from carvelake.functions.patterns import flattened
from carvelake.functions.scalars import entropy


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _strings(text: Column, may: Column | None) -> list[Column]:
    """Whether each string of each rule occurs, in their order."""
    found = lambda p, nocase: text.rlike("(?s)" + flattened(("(?i)" if nocase else "") + p, False))
    return [may_match(may, "behaviours", f"{rule}.{n}", found(p, nocase)) for rule, body in V.BEHAVIOURS.items() for n, (p, nocase) in body[-1].items()]


def _rules(strings: Column, dense: Column) -> dict[str, Column]:
    """Rule name -> whether it fires, from an array of what `_strings` found. Rules without an entry here fire when any of their strings occurs."""
    places = iter(range(sum(len(body[-1]) for body in V.BEHAVIOURS.values())))
    s = {rule: {n: F.get(strings, F.lit(next(places))) for n in body[-1]} for rule, body in V.BEHAVIOURS.items()}
    any_of = {rule: _any(list(strings.values())) for rule, strings in s.items()}
    r = dict(any_of)

    def pick(rule: str, *names: str) -> Column:
        return _any([s[rule][n] for n in names])

    x = s["ZlibObfuscatedExec"]
    r["ZlibObfuscatedExec"] = x["zlib_dc"] & (x["binbytes"] | x["fmt_zlib"])
    x = s["NestedPickleExecution"]
    r["NestedPickleExecution"] = x["pkl_loads"] & x["fmt_pickle"]
    x = s["BytesIOLoadChain"]
    r["BytesIOLoadChain"] = (x["numpy_load"] | x["pkl_load"]) & x["binbytes"]
    x = s["MarshalObfuscation"]
    r["MarshalObfuscation"] = x["marshal_l"] & x["binbytes"]
    x = s["SteganographicPayload"]
    r["SteganographicPayload"] = (x["stego_kw"] | x["lsb_kw"]) & x["exec_dec"]
    x = s["NetworkReverseShell"]
    shell = pick("NetworkReverseShell", "bin_sh", "bash_i", "sh_i", "devtcp", "nc_e", "redir_01", "redir_10")
    r["NetworkReverseShell"] = (x["platform"] & shell) | (x["devtcp"] & x["bin_sh"]) | (x["bash_i"] & (x["redir_01"] | x["redir_10"])) | x["nc_e"]
    r["NetworkBeaconing"] = any_of["NetworkBeaconing"] & ~r["NetworkReverseShell"] & ~r["NetworkForcedURLAccess"]
    x = s["FileOperationPseudoRansomware"]
    r["FileOperationPseudoRansomware"] = x["open_call"] & x["crypto_kw"] & x["os_walk"]
    x = s["FileOperationDropping"]
    r["FileOperationDropping"] = x["open_call"] & (x["write_call"] | x["close_call"]) & ~r["FileOperationPseudoRansomware"]
    x = s["BuiltinsDictGadget"]
    r["BuiltinsDictGadget"] = x["b_name"] & (x["b_subscr"] | x["b_getitem"] | x["tag_esc"])
    x = s["ObfuscationBase64"]
    r["ObfuscationBase64"] = (x["b64_kw"] | x["b64_blob"]) & ~(x["tag_path"] | x["tag_winpath"])
    x = s["ObfuscationHighEntropy"]
    plain = ~(x["tag_path"] | x["tag_winpath"]) & ~r["ObfuscationBase64"] & ~r["ObfuscationZlib"]
    r["ObfuscationHighEntropy"] = dense & x["ent_text"] & ~x["ent_binary"] & plain
    x = s["ObfuscationHighEntropyConfirmed"]
    r["ObfuscationHighEntropyConfirmed"] = dense & x["ent_text"] & (x["exec_kw"] | x["decode_kw"]) & plain
    r["ExfiltrateSensitiveData"] = pick("ExfiltrateSensitiveData", "env_read", "getenv", "aws_cred", "ssh_key") & pick("ExfiltrateSensitiveData", "req_post", "urllib_op", "sock_send")
    r["DownloadAndExecute"] = pick("DownloadAndExecute", "urlretr", "req_get", "urlopen") & pick("DownloadAndExecute", "chmod_x", "exec_sub", "exec_os")
    x = s["SilentProcessExecution"]
    r["SilentProcessExecution"] = x["sub_func"] & x["devnull"] & (x["stdout_dn"] | x["stderr_dn"])
    x = s["LOLBASWindowsScriptHost"]
    r["LOLBASWindowsScriptHost"] = (x["wscript"] | x["cscript"]) & (x["vbs"] | x["engine"])
    x = s["LOLBASMshtaExec"]
    r["LOLBASMshtaExec"] = x["mshta"] & (x["vbs_url"] | x["js_url"] | x["hta_url"])
    x = s["LOLBASNetAssemblyExec"]
    r["LOLBASNetAssemblyExec"] = (x["installutil"] | x["regasm"] | x["regsvcs"]) & (x["uninstall"] | x["codebase"])
    x = s["ExecBase64TaintChain"]
    r["ExecBase64TaintChain"] = _any([c for n, c in x.items() if n.startswith("src_")]) & _any([c for n, c in x.items() if n.startswith("sink_")])
    x = s["DLLHijackingInjection"]
    bins = [c for n, c in x.items() if n.startswith("lolbin_")]
    two = reduce(lambda a, b: a + b, [c.cast("int") for c in bins]) >= 2
    r["DLLHijackingInjection"] = x["write_pm"] | x["create_rt"] | x["load_lib"] | (x["ctypes_kw"] & x["cdll_kw"]) | x["ld_preload"] | two | (x["wb_open"] & _any(bins))
    return r


LABEL = "array<struct<rule:string,tier:string,category:string,subcategory:string>>"


def with_behaviours(rows: DataFrame, text: str, name: str = "fired", indexed: bool = True) -> DataFrame:
    """``rows`` with the rules that fire on a text, in their order: rule, tier, category, subcategory.

    Strings are looked for once each, over those texts only that the index (`pattern_index`) doesn't rule out; the rules combine what was found.
    """
    t = F.col(text)
    step = rows.select("*", candidates(t, "behaviours").alias("_may") if indexed else F.lit(0).alias("_may"), (entropy(t) > 5.0).alias("_dense"))
    step = step.select("*", F.array(*_strings(t, F.col("_may") if indexed else None)).alias("_strings"))
    fired = _rules(F.col("_strings"), F.col("_dense"))
    labels = [F.when(fired[rule], F.struct(F.lit(rule).alias("rule"), F.lit(body[0]).alias("tier"), F.lit(body[1]).alias("category"), F.lit(body[2]).alias("subcategory"))) for rule, body in V.BEHAVIOURS.items()]
    return step.select(*[F.col(f"`{c}`") for c in rows.columns], F.filter(F.array(*labels), lambda x: x.isNotNull()).cast(LABEL).alias(name))
