"""Source lines derived from orders: forty orders make one file.

Some lines of a file are its frame (namespace, class, functions, a block
comment, calls and a string over three lines, in some files a string that never
ends); the customer number picks the text of every other line.
"""

FRAME = {
    0: ["<?php", "<?php //0abc", "<?php @Zend;"], 1: ["namespace App;"],
    2: ["class UserType {", "class OrderService {", "class GraphQLQuery {", "class CartModel {"],
    5: ["public function makeToken($request) {", "public function handle($request) {", "public function login($request) {"],
    7: ["$out = system(", "file_put_contents($p,", "$c = openssl_encrypt($d,", "$user->fill(", "$q = 'select system("],
    8: ["    $_GET['c'] // system($x)", "    serialize([$d, f(g(h(i($a))))]),", "    'aes-128-ecb', /* a, b", "    $request->all()", "  exec($x) // not a comment"],
    9: [");", "    LOCK_EX);", "    md5($x) */ $key);", ");", "from t';"], 38: ["return 1;", "$y = 2;", "", "$x = \"never ends"],
    14: ["}"], 15: ["public function login($request) {", "public function logout() {", "public function upload($request) {"], 24: ["}"],
    25: ["public function resolve($root) {", "public function show($id) {"], 33: ["}"], 34: ["/* legacy", "// old"], 36: ["end of legacy */", "// end"], 39: ["}"],
}

POOL = [
    "$h = md5($password);", "$h = md5($url);", "system('ls');", "system($_GET['cmd']);", "$rows = $wpdb->query($sql);",
    "$collection->find($f);", "include $page;", "include 'a.php';", "include($base . '/x.php');", "file_put_contents($p, $d);",
    "file_put_contents($p, $d, LOCK_EX);", "if ($token == $stored) { return true; }", "if ($count === $total) { return; }",
    "protected $guarded = [];", "public function __wakeup() { }", "libxml_disable_entity_loader(true);", "libxml_disable_entity_loader(false);",
    "$x = eval('return ' . $code . ';');", "$n = mt_rand(0, 9999);", "$c = openssl_encrypt($d, 'AES-128-ECB', $key);",
    "$c = mcrypt_encrypt($a, $b);", "$user->fill($request->all());", "$obj->$method($x);", "$func($x);", "DB::raw('id = ' . $id);",
    "User::where('id', $id)->first();", "if (file_exists($f)) { include $f; }", "'resolve' => function ($root) { return 1; },",
    "$redis->eval($script);", "$pdo->query('select * from t where id = ' . $_GET['id']);", "echo $_GET['q'];", "{!! $bio !!}",
    "$twig->createTemplate($input);", "el.innerHTML = x;", "$data = simplexml_load_string($xml);", "$dom->loadXML($xml);", "$xml->xpath($q);",
    "$r = file_get_contents($_GET['url']);", "$ip = gethostbyname($host);", "curl_exec($ch);", "$c = new SoapClient($wsdl);",
    "readfile('docs/' . $name);", "move_uploaded_file($tmp, $dir . $_FILES['f']['name']);", "$zip->extractTo($dir);", "unlink($path);",
    "unserialize($_COOKIE['data']);", "unserialize(base64_decode($raw));", "$collection->find(['u' => $_POST['u']]);",
    "$redis->set($k, $v);", "ldap_search($conn, $dn, '(uid=' . $_GET['u'] . ')');", "ldap_bind($conn, $dn, $pw);",
    "header('Location: ' . $_GET['to']);", "setcookie('a', $value);", "mail($to, $subject, $body, $headers);",
    "header('X-Id: ' . $id);", "error_log($msg);", "Log::info('login', $request->all());", "Log::error('bad password ' . $password);",
    "protected $except = ['api/*'];", "Route::get('/delete/{id}', 'A@b');", "Route::any('/admin/{action}', 'A@b');",
    "Route::post('/orders', 'OrderController@store');", "Route::resource('photos', PhotoController::class);",
    "$order = Order::find($_GET['id']);", "JWT::decode($jwt);", "in_array($role, ['admin']);", "session_start();", "$_SESSION['user_id'] = $id;",
    "session_regenerate_id(true);", "session_destroy();", "ini_set('session.cookie_httponly', 0);", "$token = md5(time());", "$iv = str_repeat('0', 16);",
    "if ($hash === $mac) { return; }", "$balance = getBalance($id);", "deduct($id, $amount);", "$count = $q->count();", "Order::create($row);",
    "var_dump($user);", "echo $e->getMessage();", "$apiKey = 'sk-live-123456';", "return response()->json($user);", "phpinfo();",
    "ini_set('display_errors', '1');", "APP_DEBUG=true", "add_action('wp_ajax_nopriv_save', 'save');", "check_ajax_referer('save');",
    "$price = $_POST['price'];", "$coupon = Coupon::where('code', $c);", "$order->apply($coupon);", "sendResetLink($mail);", "$qty = abs($n);",
    "$id = $_GET['id'];", "$f = $_FILES['file'];", "Event::dispatch(OrderPaid);", "OrderPaid::class => SendReceipt::class,", "$table->string('name', 100);",
    "$table->integer('age');", "$table->json('data');", "'mail' => 'email|max:255',", "'age' => 'integer|min:0',", "return $this->hasMany(Comment::class);",
    "return $this->belongsTo(Account::class);", "return $this->belongsToMany(Role::class);", "$u = fetch('/api/users');", "$a = axios.get('/api/orders/list');",
    "call_user_func($cb, 1);", "printf($fmt);", "$x = 1; // md5($password) here", "/* exec($x) */ $y = 2;", "# system($x)", "return $next;",
    "eval(base64_decode($x));", "$v = $this->argument('file');", "$schedule->command('report');", "class SendMail implements ShouldQueue { }",
    "$router->connect('/pages', ['controller' => 'Pages']);", "register_rest_route('wp/v2', '/custom', []);", "$routes->get('list', 'Home::index');",
    "foreach ($rows as $row) { print($row); }", "throw new RuntimeException('no');", "$s = match (true) { default => 0 };", "function double(int $x): int { return $x; }",
    "enum Suit: string { }", "#[Route('/path')]", "$user?->name;", "declare(strict_types=1);", "wp_remote_get($u);", "update_option('siteurl', $v);",
    "$x = 'call system($y) or exec(1) now';",
    "$this->app->bind(Gateway::class, PayGateway::class);", "$this->app->singleton(Store::class, Gateway::class);", "$g = resolve(Gateway::class);", "app(Store::class)->save($_POST['x']);",
    "class PayGateway extends BaseGateway implements Gateway, Countable { public function pay($x) { system($x); } }", "interface Gateway extends Wire { }", "add_action('init', 'on_init', 5);",
    "add_filter('init', 'late_init');", "do_action('init', $_GET['q']);", "function on_init($x) { system($x); late_init($x); }", "function late_init($x) { exec($x); }",
    "dispatch(new ProcessData($in));", "ProcessData::dispatch($in);", "Bus::chain([new StepOne($a), new StepTwo()]);", "Queue::push(StepTwo::class, $d);",
    "$p->through([TrimInput::class, CheckRole::class]);", "Event::listen(OrderPaid::class, StepOne::class);", "class StepOne { public function handle($x) { passthru($x); } }", "$this->resolve($_GET['z']);",
    "'default' => env('DB_CONNECTION', 'pgsql'),", "DB_CONNECTION=sqlite", "$q .= ' LIMIT ?,?';", "$q .= ' OFFSET 5 ROWS FETCH NEXT 5';", "id INTEGER PRIMARY KEY AUTOINCREMENT",
    "define('DB_HOST', 'localhost');", "$m = new MongoDB/Client($u);", "$wp_version = '6.4.2';", "$wp_version = '6.10-beta1';",
]


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_sql() -> str:
    """The text of a line as one SQL expression."""
    pool = " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(POOL))
    frame = []
    for pos, options in FRAME.items():
        inner = " ".join(f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(options))
        frame.append(f"WHEN {pos} THEN CASE CAST(floor(o_orderkey / 40) AS BIGINT) % {len(options)} {inner} END")
    return f"CASE o_orderkey % 40 {' '.join(frame)} ELSE CASE o_custkey % {len(POOL)} {pool} END END"
