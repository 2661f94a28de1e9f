import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).parent.parent)
sys.path.insert(0, ROOT)
# for the workers, which may start in another folder
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

from docframe.sources.schema import SCHEMA_FILE  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SHOP = {
    SCHEMA_FILE: """---
type: database
name: shop
foreign_keys:
  - from: orders.customer
    to: customers.path
  - from: orders.tags
    to: tags.path
views:
  - name: open_orders
    query: SELECT path, customer, amount FROM orders WHERE status = 'open'
  - name: big_open
    query: SELECT path FROM open_orders WHERE amount > 5
---

# shop
""",
    f"customers/{SCHEMA_FILE}": """---
type: schema
table: customers
frontmatter:
  title: {type: string, required: true}
h1: {required: false}
---
""",
    "customers/ann.md": '---\ntitle: "Ann"\n---\n',
    "customers/bob.md": '---\ntitle: "Bob"\n---\n',
    f"orders/{SCHEMA_FILE}": """---
type: schema
table: orders
frontmatter:
  title: {type: string, required: true}
  customer: {type: string}
  status: {type: string, enum: [open, closed]}
  amount: {type: int}
  price: {type: float}
  due: {type: date}
  tags: {type: "string[]"}
  params: {type: dict}
h1: {required: true, must_equal_frontmatter: title}
sections:
  Summary: {type: markdown, required: true}
  Go-Live Notes: {type: markdown}
rules:
  normalize_numbered_headings: true
---

Orders of the shop.
""",
    "orders/first.md": """---
title: "First"
customer: ann.md
status: open
amount: 3
price: 2
due: "2024-05-01"
tags: [red.md, blue.md]
params: {size: 10, kind: a}
created: "2024-01-02T03:04:05"
---

# First

ignored text

## 1. Summary

Some `code` and
```
## not a heading
```

### deeper

## Go-Live Notes

go
""",
    "orders/second.md": """---
title: "Second"
customer: zoe.md
status: open
amount: 9
due: "2024-05-03"
---

# Second

## Summary

two
""",
    "orders/third.md": """---
title: "Third"
status: closed
amount: 20
tags: []
---

# Third

## Summary

three
""",
    "orders/broken.md": """---
title: "Broken"
status: lost
amount: "many"
colour: red
---

# Other

## Summary

## Extra
""",
    f"tags/{SCHEMA_FILE}": "---\ntype: schema\ntable: tags\nh1: {required: false}\nrules: {reject_unknown_frontmatter: false, reject_unknown_sections: false}\n---\n",
    "tags/red.md": "---\ncolour: warm\n---\n\n## Use\n\nalerts\n",
    "tags/green.md": "---\nrank: 4\n---\n",
}


@pytest.fixture
def shop(tmp_path):
    root = tmp_path / "shop"
    for name, text in SHOP.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return root
