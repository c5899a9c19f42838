"""The built-in registry: calls that reach the network, and calls that register routes.

A row is a library, what its calls are, the argument (from 0) that holds the address, and the calls; full names are made of both by the
sign that the language puts between them. A call counts as inbound by its category, and a queue's receiving call is inbound too.
"""

from __future__ import annotations

# Libraries and their calls, by language.
GO = (
    ("net/http", "http_client", 0, "Get Post PostForm Head"),
    ("net/http", "http_client", 1, "NewRequest"),
    ("net/http", "http_client", 2, "NewRequestWithContext"),
    ("net/http", "http_client", 0, "Client.Do Client.Get Client.Post Client.PostForm Client.Head"),
    ("github.com/go-resty/resty/v2", "http_client", 0, "Client.R Request.Get Request.Post"),
    ("net/http", "http_server", 0, "ListenAndServe ListenAndServeTLS Server.ListenAndServe Server.ListenAndServeTLS Serve ServeTLS"),
    ("github.com/gin-gonic/gin", "http_server", 0, "Engine.Run Engine.RunTLS"),
    ("github.com/labstack/echo/v4", "http_server", 0, "Echo.Start Echo.StartTLS"),
    ("github.com/gofiber/fiber/v2", "http_server", 0, "App.Listen App.ListenTLS"),
    ("google.golang.org/grpc", "grpc_client", 0, "Dial NewClient"),
    ("google.golang.org/grpc", "grpc_client", 1, "DialContext"),
    ("google.golang.org/grpc", "grpc_server", 0, "NewServer Server.Serve"),
    ("github.com/gorilla/websocket", "websocket_client", 0, "Dialer.Dial"),
    ("github.com/gorilla/websocket", "websocket_client", 1, "Dialer.DialContext"),
    ("github.com/gorilla/websocket", "websocket_server", 0, "Upgrader.Upgrade"),
    ("nhooyr.io/websocket", "websocket_client", 1, "Dial"),
    ("nhooyr.io/websocket", "websocket_server", 0, "Accept"),
    ("github.com/segmentio/kafka-go", "kafka_producer", 0, "Writer.WriteMessages NewWriter"),
    ("github.com/segmentio/kafka-go", "kafka_consumer", 0, "NewReader Reader.ReadMessage"),
    ("github.com/confluentinc/confluent-kafka-go/kafka", "kafka_producer", 0, "NewProducer"),
    ("github.com/confluentinc/confluent-kafka-go/kafka", "kafka_consumer", 0, "NewConsumer"),
    ("github.com/Shopify/sarama", "kafka_producer", 0, "NewSyncProducer NewAsyncProducer"),
    ("github.com/Shopify/sarama", "kafka_consumer", 0, "NewConsumer NewConsumerGroup"),
    ("database/sql", "database", 1, "Open"),
    ("github.com/jmoiron/sqlx", "database", 1, "Open Connect"),
    ("github.com/jackc/pgx/v5", "database", 1, "Connect"),
    ("github.com/jackc/pgx/v5/pgxpool", "database", 1, "New"),
    ("go.mongodb.org/mongo-driver/mongo", "database", 0, "Connect NewClient"),
    ("gorm.io/gorm", "database", 0, "Open"),
    ("github.com/redis/go-redis/v9", "redis", 0, "NewClient NewClusterClient"),
    ("github.com/go-redis/redis/v8", "redis", 0, "NewClient NewClusterClient"),
    ("github.com/gomodule/redigo/redis", "redis", 0, "Dial DialURL"),
    ("github.com/aws/aws-sdk-go-v2/service/sqs", "sqs", 0, "Client.SendMessage Client.ReceiveMessage"),
    ("github.com/aws/aws-sdk-go/service/sqs", "sqs", 0, "SQS.SendMessage SQS.ReceiveMessage"),
    ("github.com/aws/aws-sdk-go-v2/service/s3", "s3", 0, "Client.PutObject Client.GetObject"),
    ("github.com/aws/aws-sdk-go/service/s3", "s3", 0, "S3.PutObject S3.GetObject"),
    ("net", "tcp_dial", 1, "Dial DialTimeout"),
    ("net", "tcp_dial", 2, "DialContext Dialer.DialContext"),
    ("net", "tcp_listen", 1, "Listen ListenPacket"),
    ("github.com/nats-io/nats.go", "kafka_producer", 0, "Connect Conn.Publish"),
    ("github.com/nats-io/nats.go", "kafka_consumer", 0, "Conn.Subscribe"),
    ("github.com/rabbitmq/amqp091-go", "kafka_producer", 0, "Dial Channel.Publish"),
    ("github.com/rabbitmq/amqp091-go", "kafka_consumer", 0, "Channel.Consume"),
    ("github.com/streadway/amqp", "kafka_producer", 0, "Dial Channel.Publish"),
    ("github.com/streadway/amqp", "kafka_consumer", 0, "Channel.Consume"),
)
PYTHON = (
    ("requests", "http_client", 0, "get post put delete patch head options Session.get Session.post Session.put Session.delete Session.patch"),
    ("urllib.request", "http_client", 0, "urlopen"),
    ("urllib3", "http_client", 0, "HTTPConnectionPool"),
    ("httpx", "http_client", 0, "get post put delete AsyncClient.get AsyncClient.post Client.get Client.post"),
    ("aiohttp.ClientSession", "http_client", 0, "get post put delete"),
    ("aiohttp.ClientSession", "http_client", 1, "request"),
    ("flask", "http_server", 0, "Flask.run"),
    ("django.core.management", "http_server", 0, "runserver"),
    ("uvicorn", "http_server", 0, "run"),
    ("gunicorn.app.wsgiapp", "http_server", 0, "run"),
    ("fastapi", "http_server", 0, "FastAPI"),
    ("aiohttp.web", "http_server", 0, "run_app"),
    ("grpc", "grpc_client", 0, "insecure_channel secure_channel aio.insecure_channel aio.secure_channel"),
    ("grpc", "grpc_server", 0, "server aio.server Server.add_insecure_port Server.add_secure_port"),
    ("websockets", "websocket_client", 0, "connect"),
    ("websockets", "websocket_server", 0, "serve"),
    ("websocket", "websocket_client", 0, "WebSocket.connect create_connection"),
    ("kafka", "kafka_producer", 0, "KafkaProducer KafkaProducer.send"),
    ("kafka", "kafka_consumer", 0, "KafkaConsumer"),
    ("confluent_kafka", "kafka_producer", 0, "Producer"),
    ("confluent_kafka", "kafka_consumer", 0, "Consumer"),
    ("psycopg2", "database", 0, "connect"),
    ("psycopg", "database", 0, "connect AsyncConnection.connect"),
    ("pymysql", "database", 0, "connect"),
    ("mysql.connector", "database", 0, "connect"),
    ("sqlite3", "database", 0, "connect"),
    ("pymongo", "database", 0, "MongoClient"),
    ("motor.motor_asyncio", "database", 0, "AsyncIOMotorClient"),
    ("sqlalchemy", "database", 0, "create_engine ext.asyncio.create_async_engine"),
    ("databases", "database", 0, "Database"),
    ("redis", "redis", 0, "Redis StrictRedis from_url asyncio.Redis cluster.RedisCluster"),
    ("aioredis", "redis", 0, "create_redis from_url"),
    ("boto3", "sqs", 0, "client.SQS.send_message client.SQS.receive_message resource.sqs.Queue.send_message"),
    ("boto3", "s3", 0, "client.S3.put_object client.S3.get_object client.S3.upload_file client.S3.download_file"),
    ("socket", "tcp_dial", 0, "socket.connect create_connection"),
    ("socket", "tcp_listen", 0, "socket.bind"),
    ("asyncio", "tcp_dial", 0, "open_connection"),
    ("asyncio", "tcp_listen", 0, "start_server"),
    ("pika", "kafka_producer", 0, "BlockingConnection SelectConnection"),
    ("aio_pika", "kafka_producer", 0, "connect connect_robust"),
    ("celery", "kafka_producer", 0, "Celery"),
)
TYPESCRIPT = (
    ("", "http_client", 0, "fetch"),
    ("node-fetch", "http_client", 0, "default"),
    ("axios", "http_client", 0, "get post put delete patch request create"),
    ("got", "http_client", 0, "get post"),
    ("superagent", "http_client", 0, "get post"),
    ("http", "http_client", 0, "request get"),
    ("https", "http_client", 0, "request get"),
    ("undici", "http_client", 0, "fetch request"),
    ("http", "http_server", 0, "createServer"),
    ("https", "http_server", 0, "createServer"),
    ("", "http_server", 0, "express fastify koa"),
    ("express", "http_server", 0, "Application.listen"),
    ("fastify", "http_server", 0, "FastifyInstance.listen"),
    ("koa", "http_server", 0, "Application.listen"),
    ("hapi", "http_server", 0, "server"),
    ("@hapi/hapi", "http_server", 0, "server"),
    ("nestjs/core", "http_server", 0, "NestFactory.create"),
    ("@nestjs/core", "http_server", 0, "NestFactory.create"),
    ("@grpc/grpc-js", "grpc_client", 0, "credentials.createInsecure Client makeClientConstructor"),
    ("@grpc/grpc-js", "grpc_server", 0, "Server Server.bindAsync"),
    ("grpc", "grpc_client", 0, "Client"),
    ("grpc", "grpc_server", 0, "Server"),
    ("ws", "websocket_client", 0, "WebSocket"),
    ("ws", "websocket_server", 0, "WebSocketServer"),
    ("", "websocket_client", 0, "WebSocket"),
    ("socket.io", "websocket_server", 0, "Server"),
    ("socket.io-client", "websocket_client", 0, "io"),
    ("kafkajs", "kafka_producer", 0, "Kafka Kafka.producer Producer.send"),
    ("kafkajs", "kafka_consumer", 0, "Kafka.consumer Consumer.subscribe"),
    ("pg", "database", 0, "Pool Client"),
    ("mysql2", "database", 0, "createConnection createPool"),
    ("mysql", "database", 0, "createConnection createPool"),
    ("mongoose", "database", 0, "connect createConnection"),
    ("mongodb", "database", 0, "MongoClient MongoClient.connect"),
    ("", "database", 0, "knex better-sqlite3"),
    ("sequelize", "database", 0, "Sequelize"),
    ("typeorm", "database", 0, "createConnection DataSource"),
    ("prisma", "database", 0, "PrismaClient"),
    ("redis", "redis", 0, "createClient"),
    ("ioredis", "redis", 0, "Redis Cluster"),
    ("@aws-sdk/client-sqs", "sqs", 0, "SQSClient.send SendMessageCommand ReceiveMessageCommand"),
    ("@aws-sdk/client-s3", "s3", 0, "S3Client.send PutObjectCommand GetObjectCommand"),
    ("net", "tcp_dial", 0, "createConnection connect Socket.connect"),
    ("net", "tcp_listen", 0, "createServer"),
    ("tls", "tcp_dial", 0, "connect"),
    ("amqplib", "kafka_producer", 0, "connect"),
    ("amqp-connection-manager", "kafka_producer", 0, "connect"),
)
JAVA = (
    ("java.net", "http_client", 0, "http.HttpClient.send http.HttpClient.sendAsync http.HttpRequest.newBuilder URL.openConnection HttpURLConnection.connect"),
    ("org.apache.http", "http_client", 0, "client.HttpClient.execute impl.client.CloseableHttpClient.execute impl.client.HttpClients.createDefault"),
    ("okhttp3", "http_client", 0, "OkHttpClient.newCall Request.Builder.url"),
    ("org.springframework.web.client.RestTemplate", "http_client", 0, "getForObject postForObject exchange"),
    ("org.springframework.web.reactive.function.client.WebClient", "http_client", 0, "create Builder.baseUrl"),
    ("retrofit2", "http_client", 0, "Retrofit.Builder.baseUrl"),
    ("com.sun.net.httpserver", "http_server", 0, "HttpServer.create"),
    ("org.eclipse.jetty.server", "http_server", 0, "Server"),
    ("io.grpc", "grpc_client", 0, "ManagedChannelBuilder.forAddress ManagedChannelBuilder.forTarget netty.NettyChannelBuilder.forAddress netty.shaded.io.grpc.netty.NettyChannelBuilder.forAddress"),
    ("io.grpc", "grpc_server", 0, "ServerBuilder.forPort netty.NettyServerBuilder.forPort"),
    ("java.sql", "database", 0, "DriverManager.getConnection"),
    ("javax.sql", "database", 0, "DataSource.getConnection"),
    ("com.zaxxer.hikari", "database", 0, "HikariDataSource HikariConfig.setJdbcUrl"),
    ("org.springframework.jdbc.datasource", "database", 0, "DriverManagerDataSource"),
    ("com.mongodb", "database", 0, "client.MongoClients.create MongoClient ConnectionString"),
    ("redis.clients.jedis", "redis", 0, "Jedis JedisPool JedisCluster"),
    ("io.lettuce.core", "redis", 0, "RedisClient.create"),
    ("org.springframework.data.redis.connection", "redis", 0, "RedisStandaloneConfiguration"),
    ("org.redisson", "redis", 0, "Redisson.create"),
    ("org.apache.kafka.clients.producer", "kafka_producer", 0, "KafkaProducer KafkaProducer.send"),
    ("org.apache.kafka.clients.consumer", "kafka_consumer", 0, "KafkaConsumer KafkaConsumer.subscribe"),
    ("org.springframework.kafka.core", "kafka_producer", 0, "KafkaTemplate.send"),
    ("javax.websocket", "websocket_client", 0, "ContainerProvider.getWebSocketContainer"),
    ("javax.websocket", "websocket_client", 1, "WebSocketContainer.connectToServer"),
    ("org.java_websocket.client", "websocket_client", 0, "WebSocketClient"),
    ("software.amazon.awssdk.services.sqs", "sqs", 0, "SqsClient.sendMessage SqsClient.receiveMessage"),
    ("com.amazonaws.services.sqs", "sqs", 0, "AmazonSQS.sendMessage AmazonSQS.receiveMessage"),
    ("software.amazon.awssdk.services.s3", "s3", 0, "S3Client.putObject S3Client.getObject"),
    ("com.amazonaws.services.s3", "s3", 0, "AmazonS3.putObject AmazonS3.getObject"),
    ("java.net", "tcp_dial", 0, "Socket Socket.connect"),
    ("java.net", "tcp_listen", 0, "ServerSocket ServerSocket.bind"),
    ("java.nio.channels", "tcp_dial", 0, "SocketChannel.open"),
    ("java.nio.channels", "tcp_listen", 0, "ServerSocketChannel.open"),
    ("io.netty.bootstrap", "tcp_dial", 0, "Bootstrap.connect"),
    ("io.netty.bootstrap", "tcp_listen", 0, "ServerBootstrap.bind"),
    ("com.rabbitmq.client", "kafka_producer", 0, "ConnectionFactory.newConnection Channel.basicPublish"),
    ("com.rabbitmq.client", "kafka_consumer", 0, "Channel.basicConsume"),
)
C = (
    ("", "tcp_dial", 1, "connect"),
    ("", "tcp_listen", 1, "bind"),
    ("", "tcp_listen", 0, "listen accept accept4 recv recvfrom"),
    ("", "tcp_dial", 0, "send sendmsg"),
    ("", "tcp_dial", 4, "sendto"),
    ("", "http_client", 2, "curl_easy_setopt"),
    ("", "http_client", 0, "curl_easy_perform"),
)
CPP = (
    ("cpr", "http_client", 0, "Get Post Put Delete Session::Get Session::Post Session::SetUrl"),
    ("httplib", "http_client", 0, "Client::Get Client::Post"),
    ("beast", "http_client", 0, "http::async_write"),
    ("boost", "http_client", 0, "beast::http::write"),
    ("httplib", "http_server", 0, "Server::listen"),
    ("boost", "http_server", 0, "beast::tcp_stream::async_accept"),
    ("Pistache", "http_server", 0, "Http::Endpoint::serve"),
    ("crow", "http_server", 0, "SimpleApp::port"),
    ("drogon", "http_server", 0, "app().run"),
    ("grpc", "grpc_client", 0, "CreateChannel InsecureChannelCredentials"),
    ("grpc", "grpc_server", 0, "ServerBuilder::AddListeningPort ServerBuilder::BuildAndStart"),
    ("websocketpp", "websocket_client", 0, "client::connect"),
    ("websocketpp", "websocket_server", 0, "server::listen"),
    ("ix", "websocket_client", 0, "WebSocket::setUrl"),
    ("ix", "websocket_server", 0, "WebSocketServer"),
    ("beast::websocket::stream", "websocket_client", 1, "handshake async_handshake"),
    ("beast::websocket::stream", "websocket_server", 0, "accept async_accept"),
    ("boost::asio", "tcp_dial", 0, "ip::tcp::socket::connect ip::tcp::socket::async_connect connect"),
    ("boost::asio::ip::tcp::acceptor", "tcp_listen", 0, "accept async_accept bind"),
    ("pqxx", "database", 0, "connection"),
    ("MYSQL", "database", 1, "mysql_real_connect"),
    ("", "database", 1, "mysql_real_connect"),
    ("", "database", 0, "sqlite3_open sqlite3_open_v2"),
    ("mongocxx", "database", 0, "client uri"),
    ("sw::redis", "redis", 0, "Redis RedisCluster"),
    ("cpp_redis", "redis", 0, "client::connect"),
    ("", "redis", 0, "redisConnect redisConnectWithTimeout"),
    ("RdKafka", "kafka_producer", 0, "Producer::create"),
    ("RdKafka", "kafka_consumer", 0, "Consumer::create KafkaConsumer::create"),
    ("", "kafka_producer", 0, "rd_kafka_new"),
)

# What registers routes. A row is a library, the arguments that hold the pattern and the handler, and the calls.
ROUTES = (
    ("net/http", 0, 1, "HandleFunc Handle ServeMux.HandleFunc ServeMux.Handle"),
    ("github.com/gin-gonic/gin", 0, 1, "Engine.GET Engine.POST Engine.PUT Engine.DELETE Engine.PATCH RouterGroup.GET RouterGroup.POST RouterGroup.PUT RouterGroup.DELETE RouterGroup.PATCH"),
    ("github.com/labstack/echo/v4", 0, 1, "Echo.GET Echo.POST Echo.PUT Echo.DELETE"),
    ("github.com/go-chi/chi/v5", 0, 1, "Mux.Get Mux.Post Mux.Put Mux.Delete Mux.Patch"),
    ("github.com/gorilla/mux", 0, 1, "Router.HandleFunc Router.Handle"),
    ("github.com/gofiber/fiber/v2", 0, 1, "App.Get App.Post App.Put App.Delete"),
    ("flask", 0, 1, "Flask.route Blueprint.route"),
    ("flask", 0, 2, "Flask.add_url_rule"),
    ("fastapi", 0, 1, "FastAPI.get FastAPI.post FastAPI.put FastAPI.delete APIRouter.get APIRouter.post APIRouter.put APIRouter.delete"),
    ("django", 0, 1, "urls.path urls.re_path conf.urls.url"),
    ("aiohttp.web.Application.router", 0, 1, "add_get add_post"),
    ("aiohttp.web.Application.router", 1, 2, "add_route"),
    ("express", 0, 1, "Application.get Application.post Application.put Application.delete Application.patch Router.get Router.post Router.put Router.delete"),
    ("fastify", 0, 1, "FastifyInstance.get FastifyInstance.post FastifyInstance.put FastifyInstance.delete"),
    ("koa-router", 0, 1, "Router.get Router.post Router.put Router.delete"),
    ("hono", 0, 1, "Hono.get Hono.post Hono.put Hono.delete"),
    ("org.springframework.web.bind.annotation", 0, 0, "GetMapping PostMapping PutMapping DeleteMapping PatchMapping RequestMapping"),
    ("javax.ws.rs", 0, 0, "Path"),
    ("jakarta.ws.rs", 0, 0, "Path"),
)

LANGUAGES = (("go", ".", GO), ("python", ".", PYTHON), ("typescript", ".", TYPESCRIPT), ("java", ".", JAVA), ("c", ".", C), ("cpp", "::", CPP))


def full_name(library: str, sign: str, name: str) -> str:
    return f"{library}{sign}{name}" if library else name


def sink_rows(inbound: tuple[str, ...]) -> list[tuple[str, str, str, int, str]]:
    """language, full name, category, address argument and direction of every call. inbound: the categories that are."""
    rows = []
    for language, sign, table in LANGUAGES:
        for library, category, argument, names in table:
            for name in names.split():
                receives = category in inbound or (category == "sqs" and "receive" in name.lower())
                rows.append((language, full_name(library, sign, name), category, argument, "inbound" if receives else "outbound"))
    return rows


def route_rows() -> list[tuple[str, int, int]]:
    """full name, pattern argument and handler argument of every call that registers a route."""
    return [(full_name(library, ".", name), pattern, handler) for library, pattern, handler, names in ROUTES for name in names.split()]
