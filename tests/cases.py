"""Captured outputs for the end-to-end tests: an invented weather-station project, one text per kind of output."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta


@dataclass
class Case:
    name: str
    kind: str
    text: str
    command: list
    exit_code: int = 0
    required: tuple = ()
    protected: bool = False


def text_of(*parts) -> str:
    """Lines of single texts and lists of texts."""
    return "\n".join(line for part in parts for line in ([part] if isinstance(part, str) else part)) + "\n"


STATIONS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo"]


def green_specs() -> str:
    specs = [f"PASS specs/{STATIONS[i % 7]}/gauge{i}.spec.ts" for i in range(160)]
    return text_of(
        "> skywatch@4.1.0 checks", specs,
        "(node:77) Warning: rainTotals() is deprecated, call rainSums()",
        "Test Suites: 160 in total, all good", "Tests:       948 passed", "Time:        31.7 s",
    )


def red_specs() -> str:
    fine = lambda a, b: [f"PASS specs/{STATIONS[i % 7]}/probe{i}.spec.ts" for i in range(a, b)]
    return text_of(
        "> skywatch@4.1.0 checks", fine(0, 90), "FAIL specs/fir/frost.spec.ts",
        "  frost alarm > fires below zero", "    AssertionError: wanted alarm 'frost' but got 'none'",
        "      at specs/fir/frost.spec.ts:63:15", fine(90, 230),
        "Tests:       1 failed, 611 passed", "Time:        27.0 s",
    )


def collector_log() -> str:
    start, rows = datetime(2031, 3, 4, 5, 0, 0), []
    for i in range(1300):
        at = (start + timedelta(seconds=7 * i)).strftime("%Y-%m-%d %H:%M:%S")
        rows.append(f"{at} INFO poll finished station={STATIONS[0]} readings={40 + i % 9} took={i % 31}ms")
        if i % 500 == 404:
            rows.append(f"{at} WARN battery low, {11 + i % 5} percent left")
        if i == 820:
            rows += [f"{at} ERROR upload of batch B-5520 rejected by archive",
                     "ArchiveException: checksum of part 3 differs", f"{at} FATAL batch B-5520 is lost on disk 2"]
    return text_of(rows)


def readings_json() -> str:
    readings = [{"seq": n, "station": STATIONS[n % 7], "celsius": (n * 37 % 300) / 10, "state": "fine"} for n in range(420)]
    readings[251] |= {"state": "broken", "failure": "sensor reports failure code 77 on line west"}
    return json.dumps({"day": "2031-03-04", "readings": readings}, indent=1) + "\n"


def calibrate_hits() -> str:
    hits = [f"lib/drivers/{STATIONS[k % 7]}_{k % 45}.rb:{k + 12}:  calibrate(sensor_{k}, table: :factory)" for k in range(900)]
    hits[613] = "lib/drivers/west_wing.rb:88:  abort 'fatal: calibrate got a negative span'"
    return text_of(hits)


def asset_files() -> str:
    maps = [f"assets/maps/{s}/tile_{x}_{y}.png" for s in STATIONS for x in range(12) for y in range(9)]
    return text_of("Makefile", "Dockerfile", "go.mod", maps, [f"docs/months/{n}.txt" for n in range(130)])


def firmware_build() -> str:
    return text_of(
        "Reading board description", [f"Compiling unit {n} of 300 ({n // 3}%)" for n in range(1, 301)],
        ["waiting for flash chip"] * 90, "Image written: out/board.img", "Done after 74 seconds",
    )


def staged_status() -> str:
    return text_of(
        "On branch rain-sums", "", "Changes to be committed:", '  (use "git restore --staged <file>..." to unstage)',
        [f"\tnew file:   assets/icons/cloud_{n}.svg" for n in range(55)],
        [f"\tdeleted:    assets/old/sun_{n}.gif" for n in range(35)], "",
        "Changes not staged for commit:", '  (use "git add <file>..." to update what will be committed)',
        [f"\tmodified:   lib/units/{s}.rb" for s in STATIONS],
    )


def rain_patch() -> str:
    return text_of([
        [f"diff --git a/lib/units/u{n}.rb b/lib/units/u{n}.rb", f"--- a/lib/units/u{n}.rb", f"+++ b/lib/units/u{n}.rb",
         f"@@ -{n},2 +{n},2 @@ module Rain", "-  SCALE = 10", f"+  SCALE = {n + 11}"][k]
        for n in range(70) for k in range(6)
    ])


def credential_log() -> str:
    beat = lambda n: [f"INFO heartbeat from {STATIONS[3]}"] * n
    return text_of(beat(140), "DEBUG archive password=made-up-for-tests-only", beat(90))


def core_cases() -> list[Case]:
    return [
        Case("specs-green", "test", green_specs(), ["jest"], 0, ("948 passed", "rainTotals() is deprecated")),
        Case("specs-red", "test", red_specs(), ["jest", "--ci"], 1,
             ("FAIL specs/fir/frost.spec.ts", "wanted alarm 'frost' but got 'none'", "specs/fir/frost.spec.ts:63:15")),
        Case("collector", "log", collector_log(), ["head", "-n", "5000", "/var/skywatch/collector.log"], 0,
             ("ERROR upload of batch B-5520", "ArchiveException: checksum of part 3", "FATAL batch B-5520 is lost")),
        Case("readings", "json", readings_json(), ["wget", "-qO-", "http://skywatch.invalid/readings"], 0,
             ("sensor reports failure code 77",)),
        Case("hits", "search", calibrate_hits(), ["grep", "-rn", "calibrate", "lib"], 0,
             ("fatal: calibrate got a negative span", "lib/drivers/west_wing.rb")),
        Case("assets", "tree", asset_files(), ["fd", "--type", "f"], 0, ("Makefile", "Dockerfile", "go.mod")),
        Case("firmware", "generic", firmware_build(), ["flashtool"], 0, ("Image written: out/board.img", "Done after 74 seconds")),
        Case("status", "git_status", staged_status(), ["git", "status"], 0,
             ("cloud_54.svg", "assets/old/sun_34.gif", "lib/units/ginkgo.rb")),
        Case("patch", "git_diff", rain_patch(), ["git", "diff"], 0, ("+  SCALE = 80",), True),
        Case("credential", "log", credential_log(), ["cat", "archive.log"], 0, ("password=made-up-for-tests-only",), True),
    ]


def vane_run() -> str:
    return text_of(
        [f"test vane::turns_by_{n} ... ok" for n in range(110)], "test vane::locks_in_storm ... FAILED",
        "thread 'vane::locks_in_storm' panicked at src/vane.rs:204:9:", "assertion failed: vane.is_locked()",
        "test result: FAILED. 110 passed; 1 failed",
    )


def outage_json() -> str:
    masts = [{"mast": n, "height": 8 + n % 5, "report": "in order"} for n in range(75)]
    masts[70]["error"] = "anemometer timeout after gust"
    return json.dumps({"ticket": "T-19-west", "overall": "degraded", "masts": masts}, indent=3)


LETTER = (
    "The rain gauge at the northern mast counts twice because the reed switch bounces. Add a lockout of forty "
    "milliseconds in the interrupt routine, then compare a week of totals with the manual gauge."
)

#: Further cases with groups of facts; of each group one wording must stay visible.
FURTHER = [
    (Case("vane", "test", vane_run(), ["cargo", "test"], 101),
     [["test vane::locks_in_storm ... FAILED"], ["src/vane.rs:204:9", "src/vane.rs:204"], ["assertion failed"], ["1 failed"]]),
    (Case("gusts", "search", text_of(
        [f"app/{s}.kt:{n + 3}:fun gust{n}() = wind" for n in range(18) for s in STATIONS],
        "app/alarm.kt:7:throw GustError(\"no reading\")"), ["rg", "gust", "app"]),
     [["app/alarm.kt"], ["GustError"]]),
    (Case("outage", "json", outage_json(), ["wget", "-qO-", "http://skywatch.invalid/masts"]),
     [["T-19-west"], ["degraded"], ["anemometer timeout after gust"]]),
    (Case("small-patch", "git_diff", text_of(
        "diff --git a/lib/gust.rb b/lib/gust.rb", "@@ -5,3 +5,50 @@ class Gust", [f"+  limit {n}, :knots" for n in range(47)]),
        ["git", "diff"], protected=True),
     [["@@ -5,3 +5,50 @@ class Gust"], ["+  limit 46, :knots"]]),
    (Case("letter", "generic", LETTER, []), [["reed switch"], ["forty milliseconds", "40 ms"], ["manual gauge"]]),
]
