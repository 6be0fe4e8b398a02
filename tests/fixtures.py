"""Small literal inputs for operators whose domain the star schema lacks: diffs, dependency graphs and expected capabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIFFS = {
    1: """diff --git a/src/auth/login.rs b/src/auth/login.rs
index 1..2 100644
--- a/src/auth/login.rs
+++ b/src/auth/login.rs
@@ -1,4 +1,6 @@ mod login
 use std::io;
+use crate::store::users;
+pub async fn login_user(name: &str) -> bool {
+// pub fn hidden()
-pub fn old_login(name: &str) -> bool {
 body
@@ -20,2 +22,3 @@ fn log_metrics
 x
+pub const MAX_TRIES: u32 = 3;
-pub struct Session {
diff --git a/tests/test_app.py b/tests/test_app.py
new file mode 100644
--- /dev/null
+++ b/tests/test_app.py
@@ -0,0 +1,5 @@ test
+import json
+from auth import login
+def check_token(x):
+def _private(x):
+class TestApp:""",
    2: """diff --git a/web/app.ts b/web/server.ts
similarity index 90%
rename from web/app.ts
rename to web/server.ts
--- a/web/app.ts
+++ b/web/server.ts
@@ -5 +5,2 @@ serve
-export function removeMe() {}
+export async function start() {}
+app.get('/users/{id}', handler) // TODO sql
diff --git a/old.go b/old.go
deleted file mode 100644
--- a/old.go
+++ /dev/null
@@ -1,3 +0,0 @@ gone
-func Exported(a int) {
-func private(a int) {
-type Thing struct {
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ""",
    3: "",
    4: """diff --git a/db/schema.sql b/db/schema.sql
--- a/db/schema.sql
+++ b/db/schema.sql
@@ -1,2 +1,2 @@ users
-create table a
+create table b -- deprecated
diff --git a/A.java b/A.java
--- a/A.java
+++ b/A.java
@@ -1 +1,2 @@ A
+public class A {
+  public static int hashIt(int x) {""",
}
EDGES = [
    ("g1", "b", "a"), ("g1", "c", "a"), ("g1", "d", "b"), ("g1", "d", "c"), ("g1", "e", "d"), ("g1", "e", "a"),
    ("g2", "a", "b"), ("g2", "b", "c"), ("g2", "c", "a"), ("g2", "d", "c"), ("g2", "b", "a"), ("g2", "f", "zz"),
]
NODES = [*(("g1", n) for n in "abcde"), *(("g2", n) for n in "abcdf")]
EXPECTED = [("c1", "user_login", "added", ["security"]), ("c1", "user_logout", "added", ["security"]), ("c2", "get_health", "added", []), ("c3", "delete_user", "removed", ["breaking", "security"]), ("c4", "parse_config", "modified", ["domain"])]
ACTUAL = [("c1", "user_login", "added", ["security"]), ("c1", "user_logout", "added", ["security"]), ("c2", "get_health", "added", []), ("c2", "extra_thing", "added", []), ("c3", "delete_user", "modified", ["breaking", "security"]), ("c4", "render_page", "modified", ["domain"])]


def diffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIFFS.items()), "diff_id int, diff string")


def dags(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(NODES, "graph string, node string"), spark.createDataFrame(EDGES, "graph string, node string, dep string")


def cases(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    schema = "case_id string, name string, status string, categories array<string>"
    return spark.createDataFrame(EXPECTED, schema), spark.createDataFrame(ACTUAL, schema)
