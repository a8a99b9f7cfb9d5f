"""Queries over a Java project generated from the suppliers, a few files each, that uses what frameworks declare: routes, topics, events,
beans, properties, statements, repositories, functional routes, aggregate channels and sagas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.extract.java import java_rows
from claimweave.operators.resolve import annotations, channels
from claimweave.operators.resolve import java as rj
from claimweave.plans.registry import query
from claimweave.sources.corpora import table
from claimweave.tables import settled

_FILES = {
    "src/main/java/w/W{s}.java": """package w;
import org.springframework.web.bind.annotation.*;
import org.springframework.beans.factory.annotation.Autowired;
import org.springframework.beans.factory.annotation.Qualifier;
import org.springframework.kafka.annotation.KafkaListener;
import org.springframework.kafka.core.KafkaTemplate;
import org.springframework.amqp.rabbit.annotation.RabbitListener;
import org.springframework.context.ApplicationEventPublisher;
import org.springframework.context.event.EventListener;
import org.springframework.stereotype.Service;
import org.springframework.stereotype.Component;

@RestController
@RequestMapping("/s{s}")
public class W{s} {
  @Autowired private Bill{s} bean;
  @Autowired private Pay{s} pay;
  @Autowired @Qualifier("fast") private Pay{s} quick;
  @Autowired private Gone{s} gone;
  private KafkaTemplate<String, String> kafka;
  private ApplicationEventPublisher events;
  private Bus{s} bus;

  @GetMapping({"/a", "/b/{id}"})
  public String get(long id) { return bean.bill(id); }

  @PostMapping("/c")
  public void post(Ev{s} order) {
    kafka.send("t{s}", "x");
    events.publishEvent(new Ev{s}("x"));
    bus.publishEvent(new Ev{s}("y"));
    events.publishEvent(new Unknown{s}());
  }

  @DeleteMapping("/d")
  void twice(int a) { }
  @DeleteMapping("/d")
  void twice(String a) { }

  @KafkaListener(topics = {"t{s}", "r{s}"})
  void receive(String text) { }

  @RabbitListener(queues = "q{s}")
  void rabbit(String text) { }

  @EventListener
  void on(Ev{s} event) { }
}

@Service
class Bill{s} {
  String bill(long id) { return "b"; }
}

interface Pay{s} { }

@Component("fast")
class Fast{s} implements Pay{s} { }

@Component("slow")
class Slow{s} implements Pay{s} { }

class Bus{s} { }

class Ev{s} {
  Ev{s}(String name) { }
}
""",
    "src/main/java/d/D{s}.java": """package d;
import jakarta.persistence.Entity;
import jakarta.persistence.Id;
import jakarta.persistence.Table;
import org.apache.ibatis.annotations.Mapper;
import org.apache.ibatis.annotations.Select;
import org.apache.ibatis.annotations.Update;
import org.springframework.boot.context.properties.ConfigurationProperties;
import org.springframework.cloud.openfeign.FeignClient;
import org.springframework.context.annotation.Profile;
import org.springframework.context.annotation.DependsOn;
import org.springframework.web.bind.annotation.GetMapping;
import org.springframework.data.jpa.repository.JpaRepository;

@Entity
@Table(name = "users{s}")
class User{s} {
  @Id private Long id;
}

interface Users{s} extends JpaRepository<User{s}, Long> { }
interface Others{s} extends JpaRepository<Gone{s}, String> { }

@Mapper
interface Map{s} {
  @Select("select * from users{s}")
  User{s} all();
  @Update("update users{s}")
  int set(int id);
}

interface NoMap{s} {
  @Select("select 1")
  int one();
}

@Profile("dev{s}")
@DependsOn("users")
@ConfigurationProperties(prefix = "app.s{s}")
class Settings{s} { }

@ConfigurationProperties(prefix = Settings{s}.NAME)
class Dynamic{s} { }

@FeignClient(name = "billing{s}", url = "http://billing", path = "/api")
interface Client{s} {
  @GetMapping("/bills/{s}")
  String bills();
}
""",
    "src/main/java/r/R{s}.java": """package r;
import org.springframework.web.reactive.function.server.RouterFunctions;
import org.springframework.web.reactive.function.server.RequestPredicates;

class R{s} {
  RouterFunction<?> one(Hand{s} h) { return RouterFunctions.route(RequestPredicates.GET("/f{s}"), h::get); }
  RouterFunction<?> two(Hand{s} h) { return RouterFunctions.route().POST("/g{s}", h::save).DELETE("/g{s}", h::get).build(); }
  void bad(Hand{s} h) {
    RouterFunctions.route(RequestPredicates.GET(PATH), h::get);
    RouterFunctions.route(RequestPredicates.GET("/l{s}"), r -> h.get(r));
    RouterFunctions.nest(RequestPredicates.path("/n"), RouterFunctions.route(RequestPredicates.GET("/x{s}"), h::get));
    RouterFunctions.route().GET("/x{s}", h::get).filter(f()).build();
    RouterFunctions.route(RequestPredicates.GET("/o{s}"), h::over);
  }
}
""",
    "src/main/java/r/Hand{s}.java": """package r;
class Hand{s} {
  String get(Object request) { return "ok"; }
  String save(Object request) { return "saved"; }
  String over(Object request) { return "a"; }
  String over(String request) { return "b"; }
}
""",
    "src/main/java/e/Pub{s}.java": """package e;
class Pub{s} {
  private DomainEventPublisher domain;
  private Agg{s}EventPublisher wrapper;
  private LostEventPublisher lost;
  void direct(Object id) { domain.publish(Agg{s}.class, id); }
  void text(Object id) { domain.publish("x.Agg{s}", id); }
  void loose(String name, Object id) { domain.publish(name, id); }
  void wrapped(Object id) { wrapper.publishById(id); }
  void gone(Object id) { lost.publish(id); }
  @EventuateDomainEventHandler(subscriberId = "p", channel = "x.Agg{s}")
  public void handle(Object event) { }
}
class Agg{s} { }
interface Agg{s}EventPublisher extends DomainEventPublisherForAggregate<Agg{s}, Long> { }
""",
    "src/main/java/g/Saga{s}.java": """package g;
public class Saga{s} implements SimpleSaga<Data> {
  private SagaDefinition<Data> definition =
      step()
        .invokeLocal(this::create)
        .withCompensation(this::undo)
      .step()
        .invokeParticipant(this::reserve{s})
        .onReply(Full.class, this::full)
        .onReply(Closed, this::shut)
      .step()
        .invokeParticipant(this::nobody)
      .step()
        .notify(this::all)
      .build();
}
class Plain{s} { }
""",
    "src/main/java/g/Proxy{s}.java": """package g;
@SagaParticipantProxy(channel = Proxy{s}.CHANNEL)
public class Proxy{s} {
  public static final String CHANNEL = "room{s}";
  @SagaParticipantOperation(commandClass = Reserve{s}.class, replyClasses = Success.class)
  public Command reserve{s}(Data data) { return null; }
}
""",
    "src/main/java/g/Rooms{s}.java": """package g;
public class Rooms{s} {
  @EventuateCommandHandler(subscriberId = "d", channel = "room{s}")
  public Message reserve(CommandMessage<Reserve{s}> cm) { return null; }
}
""",
    "src/main/java/g/Open{s}.java": """package g;
public class Open{s} implements SimpleSaga<Data> {
  private SagaDefinition<Data> definition = maker();
}
""",
}


def _put(text: str):
    return F.replace(F.lit(text), F.lit("{s}"), F.col("s_suppkey").cast("string"))


def project(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey")
    both = F.explode(F.array(*[F.struct(_put(p).alias("path"), _put(t).alias("text")) for p, t in _FILES.items()]))
    return s.select(both.alias("f")).select("f.*")


def _parsed(spark: SparkSession, sf: str, want: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    files = project(spark, sf)
    return settled(java_rows(files, want=want)), files


def _sql(text: str) -> str:
    """A string literal of SQL with {s} put in."""
    return "(" + " || s_suppkey || ".join("'" + x.replace("'", "''") + "'" for x in text.split("{s}")) + ")"


def _rows_sql(names: list[str], rows: list[tuple]) -> str:
    """A SELECT a row, for each supplier. A value is a text with {s}, a number, a boolean, None, or SQL that starts with =."""
    def one(v: object) -> str:
        if v is None:
            return "NULL::VARCHAR"
        if isinstance(v, str):
            return v[1:] if v.startswith("=") else _sql(v)
        return str(v).upper() if isinstance(v, bool) else f"{v}::BIGINT"

    return " UNION ALL ".join("SELECT " + ", ".join(f"{one(v)} AS {n}" for n, v in zip(names, r, strict=True)) + " FROM supplier" for r in rows)


def _node(kind: str, path: str, name: str) -> str:
    return f"='claim_java_' || substr(sha256('java' || chr(0) || '{kind}' || chr(0) || {_sql(path)} || chr(0) || {_sql(name)}), 1, 16)"


def _edge(prefix: str, *parts: str) -> str:
    return "='" + prefix + "' || substr(sha256(" + " || chr(0) || ".join(p[1:] if p.startswith("=") else _sql(p) for p in parts) + "), 1, 16)"


_W, _D, _R, _H, _E, _G, _OPEN = "src/main/java/w/W{s}.java", "src/main/java/d/D{s}.java", "src/main/java/r/R{s}.java", "src/main/java/r/Hand{s}.java", "src/main/java/e/Pub{s}.java", "src/main/java/g/Saga{s}.java", "src/main/java/g/Open{s}.java"


@query("java_mvc_routes", _rows_sql(["path", "handler", "method", "route_path"], [(_W, "W{s}.get", "GET", "/s{s}/a"), (_W, "W{s}.get", "GET", "/s{s}/b/{id}"), (_W, "W{s}.post", "POST", "/s{s}/c"), (_D, "Client{s}.bills", "GET", "/bills/{s}")]))
def java_mvc_routes(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.mvc_routes(_parsed(spark, sf)[0]).select("path", "handler", "method", "route_path")


@query("java_feign_routes", _rows_sql(["path", "handler", "method", "route_path", "service_name", "service_url"], [(_D, "Client{s}.bills", "GET", "/api/bills/{s}", "billing{s}", "http://billing")]))
def java_feign_routes(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.feign_routes(_parsed(spark, sf)[0])


_RECEIVE, _POST, _ON = _node("method", _W, "W{s}.receive"), _node("method", _W, "W{s}.post"), _node("method", _W, "W{s}.on")


@query(
    "java_topic_edges",
    _rows_sql(
        ["path", "source", "source_id", "topic", "edge_kind", "edge_id", "reason"],
        [
            *[(_W, "W{s}.receive", _RECEIVE, t, "subscribes_to", _edge("claim_topic_sub_edge_", "subscribes_to", _RECEIVE, t), None) for t in ("t{s}", "r{s}")],
            (_W, "W{s}.post", _POST, "t{s}", "publishes_to", _edge("claim_topic_pub_edge_", "publishes_to", _POST, "t{s}"), None),
        ],
    ),
)
def java_topic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.topic_edges(_parsed(spark, sf)[0])


@query("java_unknown_listeners", _rows_sql(["path", "owner", "name", "reason"], [(_W, "W{s}.rabbit", "RabbitListener", "topic_annotation_not_recognized"), (_W, "W{s}.on", "EventListener", "topic_annotation_not_recognized")]))
def java_unknown_listeners(spark: SparkSession, sf: str) -> DataFrame:
    return channels.unknown_listeners(_parsed(spark, sf)[0])


_EVENT = _node("class", _W, "Ev{s}")


@query("java_event_edges", _rows_sql(["path", "owner", "target_id", "edge_kind", "edge_id"], [(_W, "W{s}.on", _EVENT, "listens_type", _edge("claim_event_type_edge_", "event_type", "listens_type", _ON, _EVENT))]))
def java_event_edges(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.event_edges(_parsed(spark, sf)[0]).select("path", "owner", "target_id", "edge_kind", "edge_id")


@query(
    "java_published_events",
    _rows_sql(
        ["path", "source", "type_name", "target_id", "edge_id", "reason"],
        [
            (_W, "W{s}.post", "Ev{s}", _EVENT, _edge("claim_event_type_edge_", "event_type", "publishes_type", _POST, _EVENT), None),
            (_W, "W{s}.post", "Ev{s}", None, None, "publish_event_receiver_not_exact_application_event_publisher"),
            (_W, "W{s}.post", "Unknown{s}", None, None, "event_type_not_unique_or_external"),
        ],
    ),
)
def java_published_events(spark: SparkSession, sf: str) -> DataFrame:
    return channels.published_events(*_parsed(spark, sf)).drop("source_id")


_BILL, _FAST = _node("class", _W, "Bill{s}"), _node("class", _W, "Fast{s}")


def _field(name: str) -> str:
    return _node("field", _W, "W{s}." + name)


INJECTED_SQL = _rows_sql(["target_id", "source_id", "edge_id", "s"], [(t, _field(n), _edge("claim_inject_edge_", "injects", "field", _field(n), t), "=s_suppkey") for n, t in (("bean", _BILL), ("quick", _FAST))])


@query(
    "java_injections",
    _rows_sql(
        ["path", "injector", "source_id", "target_id", "edge_id", "reason"],
        [
            *[(_W, "W{s}." + n, _field(n), t, _edge("claim_inject_edge_", "injects", "field", _field(n), t), None) for n, t in (("bean", _BILL), ("quick", _FAST))],
            (_W, "W{s}.pay", _field("pay"), None, None, "spring_injection_multiple_beans"),
            (_W, "W{s}.gone", _field("gone"), None, None, "spring_injection_type_not_resolved"),
        ],
    ),
)
def java_injections(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.injections(_parsed(spark, sf, rj.NEEDS["injections"])[0])


@query("java_configuration_properties", _rows_sql(["path", "owner", "owner_kind", "prefix", "edge_id", "reason"], [(_D, "Settings{s}", "class", "app.s{s}", _edge("claim_configuration_properties_edge_", "configuration_properties", _node("class", _D, "Settings{s}"), "app.s{s}"), None), (_D, "Dynamic{s}", "class", None, None, "configuration_properties_prefix_not_literal")]))
def java_configuration_properties(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.configuration_properties(_parsed(spark, sf)[0])


@query("java_mybatis_statements", _rows_sql(["path", "owner", "operation", "statement"], [(_D, "Map{s}.all", "select", "select * from users{s}"), (_D, "Map{s}.set", "update", "update users{s}")]))
def java_mybatis_statements(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.mybatis_statements(_parsed(spark, sf)[0])


@query("java_repositories", _rows_sql(["path", "repository", "base", "domain_type", "id_type", "domain_id", "reason"], [(_D, "Users{s}", "JpaRepository", "User{s}", "Long", _node("class", _D, "User{s}"), None), (_D, "Others{s}", "JpaRepository", "Gone{s}", "String", None, "type_not_found")]))
def java_repositories(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.repositories(_parsed(spark, sf)[0])


@query("java_spring_declarations", _rows_sql(["path", "owner", "owner_kind", "label", "args"], [(_D, "Settings{s}", "class", "profile", '{"value":"dev{s}"}'), (_D, "Settings{s}", "class", "depends_on", '{"value":"users"}')]))
def java_spring_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.literal_declarations(_parsed(spark, sf)[0], **annotations.SPRING)


@query("java_persistence_declarations", _rows_sql(["path", "owner", "owner_kind", "label", "args"], [(_D, "User{s}", "class", "entity", "{}"), (_D, "User{s}", "class", "table", '{"name":"users{s}"}'), (_D, "User{s}.id", "field", "id", "{}")]))
def java_persistence_declarations(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.literal_declarations(_parsed(spark, sf)[0], **annotations.PERSISTENCE)


_USES = [
    *[(_W, f"W{{s}}.{user}", name, kind, hit) for user, name, kind, hit in (("bean", "Bill{s}", "field", "class"), ("pay", "Pay{s}", "field", "interface"), ("quick", "Pay{s}", "field", "interface"), ("bus", "Bus{s}", "field", "class"), ("post", "Ev{s}", "param", "class"), ("on", "Ev{s}", "param", "class"))],
    (_D, "Map{s}.all", "User{s}", "return", "class"),
    *[(_R, f"R{{s}}.{m}", "Hand{s}", "param", "class") for m in ("one", "two", "bad")],
    (_E, "Pub{s}.wrapper", "Agg{s}EventPublisher", "field", "interface"),
]


@query("java_type_uses", _rows_sql(["path", "user", "type_name", "use_kind", "target_kind"], _USES))
def java_type_uses(spark: SparkSession, sf: str) -> DataFrame:
    return rj.type_uses(_parsed(spark, sf)[0]).where("target_id is not null").select("path", "user", "type_name", "use_kind", "target_kind")


def _route(verb: str, route: str, name: str) -> tuple:
    handler = _node("method", _H, "Hand{s}." + name)
    return (_R, verb, route, _H, "Hand{s}." + name, handler, _edge("claim_api_rel_", "api_relationship_v2", _R, verb, route, handler))


@query("java_functional_routes", _rows_sql(["path", "method", "route_path", "handler_path", "handler", "handler_id", "claim_id"], [_route("GET", "/f{s}", "get"), _route("POST", "/g{s}", "save"), _route("DELETE", "/g{s}", "get")]))
def java_functional_routes(spark: SparkSession, sf: str) -> DataFrame:
    return channels.functional_routes(*_parsed(spark, sf))


def _channel(method: str, topic: str | None, kind: str, how: str | None, reason: str | None) -> tuple:
    node = _node("method", _E, "Pub{s}." + method)
    tag = "claim_topic_pub_edge_" if kind == "publishes_to" else "claim_topic_sub_edge_"
    return (_E, "Pub{s}." + method, node, topic, kind, how, _edge(tag, kind, node, topic) if topic else None, reason)


@query(
    "java_aggregate_channels",
    _rows_sql(
        ["path", "source", "source_id", "topic", "edge_kind", "resolution", "edge_id", "reason"],
        [
            _channel("direct", "e.Agg{s}", "publishes_to", "eventuate_direct_class_literal", None),
            _channel("text", "x.Agg{s}", "publishes_to", "eventuate_direct_fqn_literal", None),
            _channel("loose", None, "publishes_to", None, "eventuate_aggregate_not_literal"),
            _channel("wrapped", "e.Agg{s}", "publishes_to", "eventuate_aggregate_wrapper_unique", None),
            _channel("gone", None, "publishes_to", None, "eventuate_publisher_wrapper_not_unique"),
            _channel("handle", "x.Agg{s}", "subscribes_to", "eventuate_literal_channel", None),
        ],
    ),
)
def java_aggregate_channels(spark: SparkSession, sf: str) -> DataFrame:
    return channels.aggregate_channels(*_parsed(spark, sf, rj.NEEDS["aggregate_channels"]))


_STEPS = ["path", "saga", "step", "kind", "method", "compensation", "replies", "channel", "command", "handlers", "reason"]
_NONE = "=NULL::BIGINT"
_FIRST = (_G, "Saga{s}", 1, "participant", "reserve{s}", None, "Full.class:full,Closed:shut", "room{s}", "Reserve{s}", "src/main/java/g/Rooms{s}.java", None)
_SECOND = (_G, "Saga{s}", 2, "participant", "nobody", None, "", None, None, None, "eventuate_saga_participant_operation_not_unique")


def _flat(steps: DataFrame) -> DataFrame:
    replies = F.array_join(F.transform("replies", lambda r: F.concat_ws(":", r["reply"], r["handler"])), ",")
    return steps.withColumn("replies", replies).withColumn("handlers", F.array_join("handlers", ",")).withColumn("step", F.col("step").cast("long"))


@query("java_saga_steps", _rows_sql(_STEPS, [(_G, "Saga{s}", 0, "local", "create", "undo", None, None, None, None, None), _FIRST, _SECOND, (_G, "Saga{s}", 3, None, None, None, None, None, None, None, "eventuate_saga_step_not_unique"), (_OPEN, "Open{s}", _NONE, None, None, None, None, None, None, None, "eventuate_saga_definition_not_literal")]))
def java_saga_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(channels.saga_steps(*_parsed(spark, sf))).select(*_STEPS)


_SAGA = _node("class", _G, "Saga{s}")
_PARTS = ["saga_id", "step", "method", "replies", "channel", "command", "handlers", "resolution"]


@query("reverse_saga_participants", "SELECT * EXCLUDE (s) FROM (" + _rows_sql(_PARTS + ["s"], [(_SAGA, *_FIRST[2:3], _FIRST[4], *_FIRST[6:10], "eventuate_saga_participant_contract_unique", "=s_suppkey"), (_SAGA, *_SECOND[2:3], _SECOND[4], *_SECOND[6:10], "eventuate_simple_saga_literal_dsl", "=s_suppkey")]) + ") WHERE s % 3 <> 0")
def reverse_saga_participants(spark: SparkSession, sf: str) -> DataFrame:
    """Of the sagas that are fresh: one supplier in three has changed its file since."""
    rows, files = _parsed(spark, sf)
    steps = settled(channels.saga_steps(rows, files))
    fresh = steps.where(F.regexp_extract("saga", r"(\d+)$", 1).cast("long") % 3 != 0).select(F.col("saga_id").alias("node_id")).distinct()
    return _flat(channels.saga_participants(steps, fresh, steps.select("saga_id"))).select(*_PARTS)
