"""Small written sources for extractors and adapters; tests say what they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PYTHON = {
    "shop/service.py": '''import json
import os
from shop.store import fetch as load, LIMIT
import shop.store

RATE = 5
DEFAULTS = {"a": 1}


class Base:
    def shared(self):
        return 1


class Service(Base):
    """Serves."""

    def run(self, x: int, *rest, flag=False, **more) -> int:
        load(x)
        self.shared()
        self.nothing()
        shop.store.fetch(x)
        if x > LIMIT:
            raise ValueError("x")
        return RATE


def setup():
    global RATE
    RATE = 6
    key = os.environ["HOME_DIR"]
    cfg = json.load(open("conf/app.json"))
    return key, cfg["db"]["host"]


async def stream():
    yield 1


@app.route("/items", methods=["GET", "post"])
def items():
    return setup()
''',
    "shop/store.py": "LIMIT = 3\n\n\ndef fetch(i):\n    return i\n",
    "shop/broken.py": "def f(:\n",
}
CONFIG = {
    "conf/app.json": '{"db": {"host": "h", "port": 1}, "name": "svc"}',
    "conf/app.toml": 'title = "t"\n[owner]\nname = "n"\n',
    "conf/app.yaml": "service:\n  port: 8080\n  name: api\nfeature: true\n",
    "conf/list.yaml": "items:\n  - a\n",
    "conf/bad.json": "{",
}
JAVA = {
    "src/main/java/app/Orders.java": '''package app;
import org.springframework.web.bind.annotation.*;
import org.springframework.stereotype.Service;
import org.springframework.beans.factory.annotation.Autowired;
import org.springframework.cache.annotation.Cacheable;
import org.springframework.scheduling.annotation.Scheduled;
import org.springframework.transaction.annotation.Transactional;
import org.springframework.kafka.annotation.KafkaListener;
import org.springframework.kafka.core.KafkaTemplate;
import org.springframework.context.event.EventListener;
import org.springframework.web.bind.annotation.RestController;
import org.springframework.web.bind.annotation.RequestMapping;

@RestController
@RequestMapping("/orders")
public class Orders {
  @Autowired private Billing billing;
  private KafkaTemplate<String, String> kafka;
  private int count = 0;

  @GetMapping({"/{id}", "/by/{id}"})
  public Order get(long id) { count++; return billing.bill(id); }

  @PostMapping
  @Transactional(readOnly = false, timeout = 5)
  public void post(Order order) { kafka.send("orders", order.name()); Runnable r = () -> get(1); }

  @Scheduled(fixedRate = 1000)
  void tick() { }

  @KafkaListener(topics = {"orders", "returns"})
  void receive(String text) { }

  @EventListener
  void on(Order event) { }
}

@Service
class Billing {
  @Cacheable(value = "bills", key = "#id")
  Order bill(long id) { return new Order("a"); }
  Order bill(String id) { return new Order(id); }
}

class Order {
  private final String name;
  Order(String name) { this.name = name; }
  String name() { return name; }
}
''',
    "src/main/java/app/Data.java": '''package app;
import jakarta.persistence.Entity;
import jakarta.persistence.Id;
import jakarta.persistence.Table;
import org.apache.ibatis.annotations.Mapper;
import org.apache.ibatis.annotations.Select;
import org.springframework.boot.context.properties.ConfigurationProperties;
import org.springframework.cloud.openfeign.FeignClient;
import org.springframework.context.annotation.Profile;
import org.springframework.web.bind.annotation.GetMapping;
import org.springframework.data.jpa.repository.JpaRepository;

@Entity
@Table(name = "users")
class User {
  @Id private Long id;
}

interface Users extends JpaRepository<User, Long> { }

@Mapper
interface UserMapper {
  @Select("select * from users")
  User all();
}

@Profile("dev")
@ConfigurationProperties(prefix = "app.data")
class Settings { }

@FeignClient(name = "billing", url = "http://billing", path = "/api")
interface BillingClient {
  @GetMapping("/bills")
  String bills();
}
''',
}


def files(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(sources.items()), "path string, text string")
