"""Pieces of SQL for the checks of queries: the same measures of text, written for another engine."""

from __future__ import annotations


def cnt(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x},'{pattern}'))"


def dev(x: str) -> str:
    return f"length(regexp_replace({x},'[^\\x{{0900}}-\\x{{097F}}]','','g'))"


def letters(x: str) -> str:
    return f"length(regexp_replace({x},'[^\\p{{L}}]','','g'))"


def latin(x: str) -> str:
    return f"length(regexp_replace({x},'[^a-zA-Z]','','g'))"


def tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x},'[ \\t\\n\\x0B\\f\\r]+'), lambda w: w<>'')"


def trim(x: str) -> str:
    return f"regexp_replace({x},'^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$','','g')"


def ratio(x: str) -> str:
    return f"(case when {letters(x)}>0 then {dev(x)}::double/{letters(x)} else 0.0 end)"


def coherence(x: str) -> str:
    w = tok(x)
    return (
        f"(case when {x} is null or {x}='' then 0.0 when len({w})<3 then 0.3 else (5"
        f"+case when list_sum(list_transform({w},lambda w: length(w)))::double/len({w}) between 3 and 12 then 2 else 0 end"
        f"+case when len(list_filter({w},lambda w: length(w)<=2))::double/len({w})<0.5 then 2 else 0 end"
        f"+case when len(list_filter({w},lambda w: length(w)>=4))::double/len({w})>0.3 then 1 else 0 end)/10.0::double end)"
    )


def garbage(x: str) -> str:
    w = tok(x)
    n, a = f"length({x})", letters(x)
    digit = f"length(regexp_replace({x},'[^\\p{{Nd}}]','','g'))"
    space = f"length(regexp_replace({x},'[^ \\t\\n\\x0B\\f\\r]','','g'))"
    low = f"length(regexp_replace(regexp_replace({x},'[^\\x{{0}}-\\x{{8ff}}]','','g'),'[^\\p{{L}}]','','g'))"
    return (
        f"(case when {x} is null or {n}<10 then true when {a}::double/{n}<0.3 then true when ({n}-{a}-{digit}-{space})::double/{n}>0.4 then true"
        f" when len({w})>5 and len(list_filter({w},lambda w: length(w)=1))::double/len({w})>0.6 then true"
        f" when {n}<100 and {dev(x)}>0 and {low}>0 and least({dev(x)},{low})<5 then true else false end)"
    )


def any_in(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x},'{w}')" for w in words) + ")"
