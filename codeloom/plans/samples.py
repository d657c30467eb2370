"""A small source tree in many languages, for the queries that show what the parsers read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import analytics
from codeloom.sources.files import graph_of, parsed

#: What a declaration in a comment or a string of the tree is called.
PHANTOM = "phantom"

TREE = {
    "src/main/java/shop/Cart.java": """package shop;

import java.util.List;

/* class PhantomCart { void phantomAdd() { } } */
public class Cart extends Box implements Countable {
    private int size;

    public Cart(int size) { this.size = size; }

    public int total(List<Item> items) {
        // phantomTotal(items);
        return sum(items);
    }

    private int sum(List<Item> items) {
        String note = "void phantomSum() { }";
        return items.size();
    }

    @Test
    void emptyCart() { total(null); }
}
""",
    "src/main/java/shop/api/CartController.java": """package shop.api;

@RestController
@RequestMapping("/carts")
public class CartController {
    @GetMapping("/{id}")
    public String find(String id) { return id; }

    // @PostMapping("/phantom")
    @PostMapping
    public void create() { }
}
""",
    "tools/report.py": '''"""class PhantomDoc: pass"""
import os


class Report:
    def rows(self):
        # def phantom_rows(self): pass
        return load(self.path)


def load(path):
    text = "def phantom_load(): pass"
    return open(path), text
''',
    "web/cart.ts": """import { post } from './http';

export interface CartView { id: string }

export class CartPage {
  // phantomRender(): void { }
  render(id: string): string { return format(id); }
}

export function format(id: string) { return `function phantomFormat() {}` + id; }
""",
    "cmd/main.go": """package main

import "fmt"

// func phantomMain() {}
type Server struct{ port int }

func (s *Server) Start() { fmt.Println(`func phantomStart() {}`) }

func main() { run() }

func run() {}
""",
    "db/schema.sql": """-- CREATE TABLE phantom_log (id INT);
CREATE TABLE carts (id BIGINT, owner VARCHAR(20));
/* CREATE TABLE phantom_items (id INT); */
INSERT INTO carts (id, owner) VALUES (1, 'CREATE TABLE phantom_text (id INT)');
SELECT id FROM carts;
""",
    "config/application.yml": """server:
  port: 8080
# phantom:
#   key: 1
shop:
  name: "phantom: text"
""",
    "config/app.properties": "# phantom.key=1\nshop.limit=5\n",
    "Dockerfile": "# FROM phantom:1\nFROM base:2\nENV SHOP_MODE=fast\nEXPOSE 8080\n",
    "pom.xml": """<project><dependencies>
<!-- <dependency><groupId>phantom</groupId><artifactId>phantom</artifactId><version>1</version></dependency> -->
<dependency><groupId>org.shop</groupId><artifactId>shop-core</artifactId><version>1.2</version></dependency>
</dependencies></project>
""",
    "infra/main.tf": """# resource "phantom" "one" {}
resource "aws_queue" "orders" {
  name = "resource phantom two"
}
""",
    "web/site.css": "/* .phantom { color: red } */\n:root { --gap: 4px; }\n.cart { color: blue }\n",
}


def tree(spark: SparkSession) -> DataFrame:
    """``path, content`` of the tree."""
    return spark.createDataFrame(list(TREE.items()), "path string, content string")


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return graph_of(parsed(tree(spark)), "sample")


def declarations(spark: SparkSession) -> DataFrame:
    """``label, fq_name`` of all that the tree declares, but for the calls that nothing in it answers."""
    return graph(spark)[0].where("NOT startswith(fq_name, 'unresolved.')").select("label", "fq_name")


def relations(spark: SparkSession) -> DataFrame:
    """``from_name, edge_type, to_name`` between what the tree declares."""
    nodes, edges = graph(spark)
    n = nodes.where("NOT startswith(fq_name, 'unresolved.')").select("id", "fq_name")
    a, b = n.select(F.col("id").alias("src"), F.col("fq_name").alias("from_name")), n.select(F.col("id").alias("dst"), F.col("fq_name").alias("to_name"))
    return edges.join(a, "src").join(b, "dst").select("from_name", "edge_type", "to_name")


def infrastructure(spark: SparkSession) -> DataFrame:
    """``section, a, b, c``: the sections of the infrastructure summary in one table."""
    out = None
    for section, df in analytics.infrastructure(graph(spark)[0]).items():
        cols = [F.col(c).cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (3 - len(df.columns))
        part = df.select(F.lit(section).alias("section"), *[c.alias(n) for c, n in zip(cols, "abc")])
        out = part if out is None else out.unionByName(part)
    return out


def audit(spark: SparkSession) -> DataFrame:
    """``label, declared, phantoms``: nodes of each label, and those whose name stands only in comments and strings."""
    n = graph(spark)[0].where("NOT startswith(fq_name, 'unresolved.') OR contains(lower(fq_name), 'phantom')")
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.lower("fq_name").contains(PHANTOM)).alias("phantoms"))


# What a reader finds in the tree.
_DECLARED = """
ApiEndpoint|GET /carts/{id}
ApiEndpoint|POST /carts
Class|shop.Cart
Class|shop.api.CartController
Class|tools/report.py::Report
Class|web/cart.ts::CartPage
Column|carts.id
Column|carts.owner
ConfigKey|server.port
ConfigKey|shop.limit
ConfigKey|shop.name
ContainerImage|base:2
ContainerPort|8080
ContainerStage|Dockerfile::base:2
CssClass|cart
DesignToken|--gap
EnvVar|SHOP_MODE
File|Dockerfile
File|cmd/main.go
File|config/app.properties
File|config/application.yml
File|db/schema.sql
File|infra/main.tf
File|pom.xml
File|src/main/java/shop/Cart.java
File|src/main/java/shop/api/CartController.java
File|tools/report.py
File|web/cart.ts
File|web/site.css
GoPackage|main
Interface|web/cart.ts::CartView
MavenDependency|org.shop:shop-core
Method|main.Server.Start
Method|main.main
Method|main.run
Method|shop.Cart.<init>(int)
Method|shop.Cart.emptyCart()
Method|shop.Cart.sum(List<Item>)
Method|shop.Cart.total(List<Item>)
Method|shop.api.CartController.create()
Method|shop.api.CartController.find(String)
Method|tools/report.py::Report.rows
Method|tools/report.py::load
Method|web/cart.ts::CartPage.render
Method|web/cart.ts::format
Module|./http
Module|fmt
Module|java.util.List
Module|os
Resource|aws_queue.orders
Struct|main.Server
Table|carts
"""
_RELATED = """
Dockerfile|CONTAINS|Dockerfile::base:2
Dockerfile::base:2|CONTAINS|SHOP_MODE
Dockerfile::base:2|DEPENDS_ON|base:2
Dockerfile::base:2|EXPOSES|8080
GET /carts/{id}|HANDLES|shop.api.CartController.find(String)
POST /carts|HANDLES|shop.api.CartController.create()
carts|CONTAINS|carts.id
carts|CONTAINS|carts.owner
cmd/main.go|CONTAINS|main.Server
cmd/main.go|CONTAINS|main.main
cmd/main.go|CONTAINS|main.run
cmd/main.go|IMPORTS|fmt
config/app.properties|CONTAINS|shop.limit
config/application.yml|CONTAINS|server.port
config/application.yml|CONTAINS|shop.name
db/schema.sql|CONTAINS|carts
db/schema.sql|READS_TABLE|carts
db/schema.sql|WRITES_TABLE|carts
infra/main.tf|CONTAINS|aws_queue.orders
main.Server|CONTAINS|main.Server.Start
main.main|CALLS|main.run
pom.xml|DECLARES|org.shop:shop-core
shop.Cart|CONTAINS|shop.Cart.<init>(int)
shop.Cart|CONTAINS|shop.Cart.emptyCart()
shop.Cart|CONTAINS|shop.Cart.sum(List<Item>)
shop.Cart|CONTAINS|shop.Cart.total(List<Item>)
shop.Cart.emptyCart()|CALLS|shop.Cart.total(List<Item>)
shop.Cart.total(List<Item>)|CALLS|shop.Cart.sum(List<Item>)
shop.api.CartController|CONTAINS|shop.api.CartController.create()
shop.api.CartController|CONTAINS|shop.api.CartController.find(String)
shop.api.CartController|EXPOSES|GET /carts/{id}
shop.api.CartController|EXPOSES|POST /carts
src/main/java/shop/Cart.java|CONTAINS|shop.Cart
src/main/java/shop/Cart.java|IMPORTS|java.util.List
src/main/java/shop/api/CartController.java|CONTAINS|shop.api.CartController
tools/report.py|CONTAINS|tools/report.py::Report
tools/report.py|CONTAINS|tools/report.py::load
tools/report.py|IMPORTS|os
tools/report.py::Report|CONTAINS|tools/report.py::Report.rows
tools/report.py::Report.rows|CALLS|tools/report.py::load
web/cart.ts|CONTAINS|web/cart.ts::CartPage
web/cart.ts|CONTAINS|web/cart.ts::CartView
web/cart.ts|CONTAINS|web/cart.ts::format
web/cart.ts|IMPORTS|./http
web/cart.ts::CartPage|CONTAINS|web/cart.ts::CartPage.render
web/cart.ts::CartPage.render|CALLS|web/cart.ts::format
web/site.css|CONTAINS|--gap
web/site.css|CONTAINS|cart
"""

_INFRASTRUCTURE = """
api_endpoints|GET|/carts/{id}|spring
api_endpoints|POST|/carts|spring
config_keys|server.port|8080|
config_keys|shop.limit|5|
config_keys|shop.name|phantom: text|
container_images|base:2|base|2
container_ports|8080|tcp|
env_vars|SHOP_MODE|fast|
terraform_resources|aws_queue.orders|aws_queue|aws
"""


def _values(lines: str, *columns: str) -> str:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in line.split("|")) + ")" for line in lines.strip().split("\n"))
    return f"(VALUES {rows}) AS t({', '.join(columns)})"


QUERIES = {
    "parsed_declarations": lambda spark, sf_dir: declarations(spark),
    "parsed_relations": lambda spark, sf_dir: relations(spark),
    "parsed_infrastructure": lambda spark, sf_dir: infrastructure(spark),
    "parsed_audit": lambda spark, sf_dir: audit(spark),
}
ORACLE = {
    "parsed_declarations": f"SELECT * FROM {_values(_DECLARED, 'label', 'fq_name')}",
    "parsed_relations": f"SELECT * FROM {_values(_RELATED, 'from_name', 'edge_type', 'to_name')}",
    "parsed_infrastructure": f"SELECT section, a, b, nullif(c, '') AS c FROM {_values(_INFRASTRUCTURE, 'section', 'a', 'b', 'c')}",
    "parsed_audit": f"SELECT label, count(*) AS declared, CAST(0 AS BIGINT) AS phantoms FROM {_values(_DECLARED, 'label', 'fq_name')} GROUP BY label",
}
