"""What each rule must and must not hit: lines written from the rules' meaning, in files of the rule's language."""

from __future__ import annotations

from gleanline.operators import rules

SCHEMA = "file long, path string, language string, content string, ranges array<struct<a:int,b:int>>"
# rule: language, a text that it must hit, one that it must not
LINES = {
    "js-dynamic-code": ("javascript", "run(new Function (body))", "page.eval(body); evaluate(x)"),
    "js-inner-html": ("typescript", "box.outerHTML += row", "box.innerHTML = DOMPurify.clean(row)"),
    "js-document-write": ("javascript", "document.writeln(row)", "mydocument.writer(row)"),
    "js-react-raw": ("typescript", "return <b dangerouslySetInnerHTML={{ __html: t }} />", "return <b>{t}</b>"),
    "js-exec-shell": ("javascript", "import { execSync } from 'child_process'\nexecSync(`rm ${name}`)", "import { execSync } from 'child_process'\nexecSync(`date`)"),
    "js-loose-null": ("javascript", "if (x == undefined) go()", "if (x === null || y !== null) go()"),
    "js-async-foreach": ("javascript", "ids.forEach( async id => load(id))", "ids.forEach(id => load(id))"),
    "js-float-promise": ("javascript", "  fetch('/a');", "  await fetch('/a');"),
    "js-empty-catch": ("javascript", "try { a() } catch (err) {\n}", "try { a() } catch (err) {\n  log(err)\n}"),
    "js-parse-int": ("javascript", "n = parseInt(row.size)", "n = parseInt(row.size, 10)"),
    "js-prototype": ("javascript", "a['__proto__'] = b", "a.prototype = b"),
    "js-random-token": ("javascript", "const sessionToken = Math.random()", "const jitter = Math.random()"),
    "js-cors-any": ("javascript", "app.use(cors({ Origin: \"*\" }))", "app.use(cors({ origin: 'https://a.example' }))"),
    "js-timer-text": ("javascript", "setInterval( \"tick()\", 9)", "setInterval(tick, 9)"),
    "js-console": ("javascript", "console.debug(x)", "#!/usr/bin/env node\nconsole.log(x)"),
    "py-dynamic-code": ("python", "exec(body)", "ast.literal_eval(body)"),
    "py-shell": ("python", "subprocess.check_output(\n    cmd,\n    shell = True)", "subprocess.run(cmd, shell=False)"),
    "py-system": ("python", "out = os.popen(cmd)", "os.path.join(a)"),
    "py-pickle": ("python", "import pickle\nx = pickle.load(f)", "import pickle\npickle.dumps(x)"),
    "py-yaml": ("python", "yaml.load(f, Loader=yaml.Loader)", "yaml.load(f, Loader=yaml.SafeLoader)"),
    "py-bare-except": ("python", "    except :", "    except OSError:"),
    "py-except-pass": ("python", "except KeyError as e:\n    pass", "except KeyError:\n    raise"),
    "py-mutable-default": ("python", "def add(x, seen={}):", "def add(x, seen=None):"),
    "py-no-verify": ("python", "get(u, verify = False)", "get(u, verify=True)"),
    "py-debug": ("python", "from flask import Flask\napp.run(debug=True)", "app.run(debug=True)"),
    "py-assert": ("python", "assert (a == b, 'no')", "assert a == b, 'no'"),
    "py-mktemp": ("python", "p = tempfile.mktemp('.x')", "p = tempfile.mkstemp('.x')"),
    "py-is-literal": ("python", "if n is not 3:", "if n is not None:"),
    "py-md5": ("python", "hashlib.sha1(b)", "hashlib.sha256(b)"),
    "go-ignored-error": ("go", "f, _ := os.Open(p)", "f, err := os.Open(p)"),
    "go-skip-verify": ("go", "tls.Config{InsecureSkipVerify: true}", "tls.Config{InsecureSkipVerify: false}"),
    "go-sprintf-sql": ("go", 'q := fmt.Sprintf("DELETE from t where a=%s", a)', 'q := fmt.Sprintf("selected %s", a)'),
    "go-defer-loop": ("go", "for i := range xs {\n\tdefer xs[i].Close()", "for i := range xs {\n\txs[i].Close()"),
    "go-panic": ("go", "\tpanic(err)", "\tdispanic(err)"),
    "go-unsafe": ("go", 'import "unsafe"\np := unsafe.Pointer(x)', 'import "unsafe"\nn := unsafe.Sizeof(x)'),
    "go-background": ("go", "ctx := context.TODO()", "ctx := r.Context()"),
    "java-query": ("java", 'em.createQuery( "from T where a=" + a)', 'em.createQuery("from T where a=:a")'),
    "java-runtime": ("kotlin", "Runtime.getRuntime().exec(cmd)", "Runtime.getRuntime().gc()"),
    "java-swallow": ("java", "} catch (IOException e) {\n}", "} catch (IOException e) {\n  throw e;\n}"),
    "java-deserialize": ("java", "import java.io.ObjectInputStream;\nObject o = in.readObject();", "Object o = in.readObject();"),
    "java-xml": ("java", "f = DocumentBuilderFactory.newInstance();", "f = DocumentBuilderFactory.newInstance();\nf.setFeature(\"http://apache.org/xml/features/disallow-doctype-decl\", true);"),
    "java-string-same": ("java", 'if (a == "b") {', 'if (a.equals("b")) {'),
    "java-print-trace": ("java", "e.printStackTrace();", "e.printStackTrace(out);"),
    "rb-send": ("ruby", "x.send( params[:a])", "x.send(:name)"),
    "rb-html-safe": ("ruby", "t.html_safe", "draw_line(t)"),
    "rb-where-text": ("ruby", 'A.where("a = #{b}")', 'A.where("a = ?", b)'),
    "rb-rescue-nil": ("ruby", "v = a.b rescue nil", "rescue NilError"),
    "php-superglobal-sql": ("php", "$db->query('select ' . $_POST['a'])", "$db->query($sql)"),
    "php-unserialize": ("php", "$a = unserialize($b);", "$a = serialize($b);"),
    "php-silence": ("php", "$a = @fopen($b);", "mail('a@b(c)');"),
    "sh-pipe-shell": ("shell", "wget -O- https://a.example | bash", "curl https://a.example | shasum"),
    "sh-rm-variable": ("shell", "rm -fr $OUT", "rm -rf out"),
    "sh-chmod-all": ("dockerfile", "RUN chmod -R 0777 /a", "RUN chmod 755 /a"),
    "c-unbounded": ("cpp", "strcat (a, b);", "strncat(a, b, n); fgets(a, n, f);"),
    "c-format": ("c", "printf( text );", "printf(\"%s\", text);"),
    "c-malloc-mul": ("c", "p = malloc(n * sizeof(int));", "p = calloc(n, sizeof(int));"),
    "docker-latest": ("dockerfile", "from base:latest", "FROM base:1.2"),
    "docker-add-url": ("dockerfile", "ADD http://a.example/x /x", "ADD x /x"),
    "docker-root": ("dockerfile", "USER root", "USER rooted"),
    "docker-curl-pipe": ("dockerfile", "RUN cat a | sh", "RUN cat a > sh"),
    "yaml-target": ("yaml", "  pull_request_target :", "  pull_request:"),
    "yaml-checkout-head": ("yaml", "on: pull_request_target\n  ref: ${{github.event.pull_request.head.ref}}", "  ref: ${{github.event.pull_request.head.ref}}"),
    "yaml-privileged": ("yaml", "  privileged: true", "  privileged: false"),
    "tf-open": ("terraform", 'cidr_blocks = [ "0.0.0.0/0" ]', 'cidr_blocks = ["10.0.0.0/8"]'),
    "tf-public": ("terraform", 'acl = "public-read-write"', 'acl = "private"'),
    "sql-no-where": ("sql", "UPDATE t set a = 1;", "update t set a = 1 where b = 2;"),
    "sql-drop": ("sql", "DROP TABLE t;", "drop table if  exists t;"),
    "any-conflict": ("go", ">>>>>>> other", ">>>>>>>> other"),
    "any-later": ("python", "# XXX mend", "# TODOS"),
    "any-http": ("java", 'u = "http://a.example/x"', 'u = "http://localhost:80"'),
    "any-password": ("php", "$PWD = 'abcdef1'", "$password = 'short'"),
    "any-debugger": ("ruby", "  binding.pry", "  breakpoint(1)"),
}


def test_each_rule_hits_what_it_must_and_spares_what_it_must_not(spark):
    assert set(LINES) == {r.id for r in rules.RULES}
    names = list(LINES)
    files = [(2 * k + miss, "src/workflows/f", LINES[name][0], LINES[name][1 + miss], None) for k, name in enumerate(names) for miss in (0, 1)]
    found = {(r.file, r.rule_id) for r in rules.scan(spark.createDataFrame(files, SCHEMA)).collect()}
    assert [n for k, n in enumerate(names) if (2 * k, n) not in found] == []
    assert [n for k, n in enumerate(names) if (2 * k + 1, n) in found] == []
