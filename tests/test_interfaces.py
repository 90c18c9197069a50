"""Endpoints and ports of many frameworks, each as its own documentation writes them."""

from __future__ import annotations

import pytest

from weft.operators import flow, interfaces
from weft.sources.files import FILES

SOURCES = {
    "a/api.py": "from flask import Flask\n@app.route('/x', methods=['GET','POST'])\n\ndef x():\n  pass\n@bp.get('')\ndef root(): pass\n@mock.patch('app.mail')\ndef t(): pass\n@ws.websocket('/w')\nasync def w(): pass\nurlpatterns = [path('u/', views.u), re_path(r'^v$', v)]\nreturn Response(s, mimetype='text/event-stream')\napp.run(host='0', port=5001)\nos.environ.get('PORT', 8000)\n",
    "b/C.java": "@Path(\"/base\")\npublic class C {\n  @GET\n  @Path(\"/one\")\n  public String one() {\n  }\n  @Path(\"/two\")\n  @POST\n  public String two() {\n  }\n  @RequestMapping(value = \"/r\", method = RequestMethod.PUT)\n  void r() {\n  }\n  @GetMapping\n  void g() {\n  }\n @KafkaListener(topics = {\"t1\"})\n void k() {\n}\n}\nclass D {\n  @GetMapping(\"/plain\")\n  void p() {\n  }\n}\n",
    "c/H.cs": "[Route(\"api\")]\npublic class H {\n  [HttpGet(\"{id}\")]\n  public X Get(int id) {\n  }\n}\napp.MapPost(\"/m\", Make);\n",
    "d/s.ts": "import { Server } from 'socket.io';\nimport { Kafka } from 'kafkajs';\nsocket.on('hi', f);\nio.emit('bye');\nconsumer.subscribe({ topic: 'orders' });\nproducer.send({ topic: 'out', messages });\napp.get(`/t/${x}`, (req, res) => {\napp.listen(cb);\napp.listen(process.env.PORT || 3000);\nsrv.listen({ port: 4000 });\nsrv.listen(PORT);\n@MessagePattern('m')\nasync m(\n",
    "config/routes.rb": "  get '/r', to: 'x'\n  resources :users\n",
    "e/r.php": "#[Route('/sym', methods: ['GET', 'POST'])]\npublic function sym() {\n}\nRoute::get('/lar', [X::class, 'y']);\n",
    "f/m.rs": "#[get(\"/rk\")]\nfn rk() {}\nlet a = Router::new().route(\"/ax\", get(h).post(h2));\n",
    "g/schema.graphql": "type Query {\n  users(first: Int): [User!]!\n  me: User\n}\ntype User {\n  id: ID\n}\n",
    "h/openapi.yaml": "openapi: 3.0.0\nservers:\n  - url: /v1\npaths:\n  /pets:\n    get:\n      summary: x\n    post:\n  '/pets/{id}':\n    delete:\n",
    "web/app/(shop)/items/[id]/route.ts": "export async function GET(req) {}\nexport const POST = handler;\n",
    "web/pages/api/hello/index.js": "export default function handler(req, res) {}\n",
    "i/svc.proto": "package shop.v1;\nservice Orders {\n  rpc Place (stream Order) returns (Receipt);\n  rpc Watch (Q) returns (stream E);\n}\n",
    "j/main.go": "http.HandleFunc(\"/h\", h)\nr.GET(\"/g\", g)\nhttp.ListenAndServe(\":9090\", nil)\nnet.Listen(\"tcp\", \"0.0.0.0:7000\")\n",
    "Dockerfile": "EXPOSE 53/udp 80 99999 x\n",
    "k/compose.yml": "services:\n  a:\n    ports:\n      - \"8080:80\"\n      - 127.0.0.1:9000:90/udp\n      - 70\n    command:\n      - \"1:2\"\n  b:\n    port: 1234\n",
    "k/deploy.yaml": "ports:\n  - containerPort: 8081\n    hostPort: 1\n  - targetPort: 82\nserver:\n  port: 8443\n",
    "l.properties": "server.port=8085\ndb_port: 5432\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, c, len(c.encode())) for p, c in SOURCES.items()], FILES)


@pytest.fixture(scope="module")
def found(files):
    return interfaces.endpoints(files).persist()


def test_endpoints(found):
    got = {(r.file, r.line, r.protocol, r.operation, r.address, r.handler) for r in found.collect()}
    assert got == {
        ("a/api.py", 2, "http", "GET", "/x", "x"), ("a/api.py", 2, "http", "POST", "/x", "x"), ("a/api.py", 6, "http", "GET", "/", "root"), ("a/api.py", 10, "websocket", "connect", "/w", "w"),
        ("a/api.py", 12, "http", "ANY", "/u", "views.u"), ("a/api.py", 12, "http", "ANY", "/v", "v"), ("a/api.py", 13, "sse", "stream", "a/api.py", None),
        ("b/C.java", 3, "http", "GET", "/base/one", "one"), ("b/C.java", 8, "http", "POST", "/base/two", "two"), ("b/C.java", 11, "http", "PUT", "/base/r", "r"),
        ("b/C.java", 14, "http", "GET", "/base", "g"), ("b/C.java", 17, "kafka", "consume", "t1", "k"), ("b/C.java", 22, "http", "GET", "/plain", "p"),
        ("c/H.cs", 3, "http", "GET", "/api/{id}", "Get"), ("c/H.cs", 7, "http", "POST", "/m", "Make"),
        ("config/routes.rb", 1, "http", "GET", "/r", None), ("config/routes.rb", 2, "http", "RESOURCE", "/users", None),
        ("d/s.ts", 3, "websocket", "on", "hi", "f"), ("d/s.ts", 4, "websocket", "emit", "bye", None), ("d/s.ts", 5, "kafka", "subscribe", "orders", None),
        ("d/s.ts", 6, "kafka", "publish", "out", None), ("d/s.ts", 7, "http", "GET", "/t/${x}", None), ("d/s.ts", 12, "kafka", "message", "m", "m"),
        ("e/r.php", 1, "http", "GET", "/sym", "sym"), ("e/r.php", 1, "http", "POST", "/sym", "sym"), ("e/r.php", 4, "http", "GET", "/lar", None),
        ("f/m.rs", 1, "http", "GET", "/rk", "rk"), ("f/m.rs", 3, "http", "GET", "/ax", None),
        ("g/schema.graphql", 2, "graphql", "query", "users", None), ("g/schema.graphql", 3, "graphql", "query", "me", None),
        ("h/openapi.yaml", 6, "http", "GET", "/pets", None), ("h/openapi.yaml", 8, "http", "POST", "/pets", None), ("h/openapi.yaml", 10, "http", "DELETE", "/pets/{id}", None),
        ("i/svc.proto", 3, "grpc", "rpc", "shop.v1.Orders/Place", None), ("i/svc.proto", 4, "grpc", "rpc", "shop.v1.Orders/Watch", None),
        ("j/main.go", 1, "http", "ANY", "/h", "h"), ("j/main.go", 2, "http", "GET", "/g", "g"),
        ("web/app/(shop)/items/[id]/route.ts", 1, "http", "GET", "/items/[id]", None), ("web/app/(shop)/items/[id]/route.ts", 2, "http", "POST", "/items/[id]", None),
        ("web/pages/api/hello/index.js", 1, "http", "ANY", "/api/hello", None),
    }
    rows = {(r.file, r.line): r for r in found.collect()}
    assert rows["i/svc.proto", 3].detail == {"Request": "stream Order", "Response": "Receipt", "Streaming": "client"}
    assert rows["g/schema.graphql", 2].detail == {"Returns": "[User!]!"} and rows["d/s.ts", 7].confidence == "inferred"


def test_ports(files, found):
    got = {(r.file, r.line, r.protocol, r.port, r.host_port, r.declared_as, r.kind, r.transport) for r in interfaces.ports(files, found).collect()}
    assert got == {
        ("Dockerfile", 1, "tcp", 53, None, None, "expose", "udp"), ("Dockerfile", 1, "http", 80, None, None, "expose", None), ("a/api.py", 14, "tcp", 5001, None, None, "listen", None),
        ("a/api.py", 15, "http", 8000, None, "PORT", "config", None), ("d/s.ts", 9, "tcp", None, None, "process.env.PORT", "listen", None), ("d/s.ts", 9, "http", 3000, None, "PORT", "config", None),
        ("d/s.ts", 10, "http", 4000, None, None, "listen", None), ("d/s.ts", 11, "tcp", None, None, "PORT", "listen", None), ("j/main.go", 3, "http", 9090, None, None, "listen", None),
        ("j/main.go", 4, "http", 7000, None, None, "listen", None), ("k/compose.yml", 4, "http", 80, 8080, None, "published", None), ("k/compose.yml", 5, "tcp", 90, 9000, None, "published", "udp"),
        ("k/compose.yml", 6, "tcp", 70, None, None, "published", None), ("k/compose.yml", 10, "tcp", 1234, None, "port", "config", None), ("k/deploy.yaml", 2, "http", 8081, None, "containerPort", "listen", None),
        ("k/deploy.yaml", 4, "tcp", 82, None, "targetPort", "published", None), ("k/deploy.yaml", 6, "http", 8443, None, "port", "config", None), ("l.properties", 1, "tcp", 8085, None, "server.port", "config", None),
        ("l.properties", 2, "tcp", 5432, None, "db_port", "config", None),
    }


def test_endpoints_get_their_module(spark, found):
    modules = spark.createDataFrame([("b/C.java", "b"), ("f/m.rs", "f")], "path string, module string")
    placed = {r.file: r.module for r in interfaces.with_module(found, modules).collect()}
    assert placed["b/C.java"] == "b" and placed["a/api.py"] is None


def test_a_route_of_the_flow_reaches_its_handler_however_far(spark):
    text = "@app.get('/far')\n" + "# words\n" * 9 + "def far():\n    load()\n\ndef load():\n    session.query(1)\n\n@app.get('/none')\n"
    nodes, edges = flow.flow_graph(spark.createDataFrame([("a.py", text, len(text))], FILES))
    assert {(r.kind, r.label) for r in nodes.collect()} >= {("start", "GET /far"), ("step", "far"), ("io", "session.query")}
    assert "GET /none" not in {r.label for r in nodes.collect()}
    assert "dispatch" in {r.kind for r in edges.collect()}
