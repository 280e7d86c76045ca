"""Source texts that stand in for code, one per language; ``{k}`` is a number that a table row puts in.

Heads stand on one line and on several; comments nest, and literals hold what looks like code. Next to each text are the
tags it must give, definitions with the lines of the heads around them. Line -1 holds the references that are filled in.
"""

from __future__ import annotations

from typing import NamedTuple


class Sample(NamedTuple):
    extension: str
    text: str
    definitions: list[tuple[int, str, list[int]]]
    references: list[tuple[int, str]]


SAMPLES: dict[str, Sample] = {}


def _sample(lang: str, extension: str, text: str, definitions: str, references: str) -> None:
    """``definitions``: ``line:name`` or ``line:name@head,head``; ``references``: ``line:name``; both split at blanks."""
    defs = []
    for entry in definitions.split():
        place, _, heads = entry.partition("@")
        line, _, name = place.partition(":")
        defs.append((int(line), name, [int(h) for h in heads.split(",") if h]))
    refs = [(int(line), name) for line, _, name in (entry.partition(":") for entry in references.split())]
    SAMPLES[lang] = Sample(extension, text, defs, refs)


_sample("python", "py", '''\
class Part{k}(
    Base,
):
    """Says def no{k}(): and "class No".
    call_no(1)"""

    async def load{k}(
        self,
        key=f"{make{k}(1)} {{no(2)}} {'a' + pick("no(3)")}",
    ):
        def inner{k}(): return r"\\" + 'def no(4): # no(5)'
        return run{k}(inner{k}) and self.stop(  # no(6)
            other(7))

    def last{k}(self): return \'\'\'no(8)
\'\'\' and save(9)
top{k} = (
    after{k})
''', "0:Part{k} 6:load{k}@0 10:inner{k}@0,6 14:last{k}@0", "8:make{k} 8:pick 11:run{k} 11:stop 12:other 15:save")

_sample("c", "c", '''\
#define NO(x) int no_##x(int y) \\
    { return no(1); }
struct
part{k}
{ int size; };
int
main{k}(int argc,
    char **argv)
{
    puts("int no(void) { \\" \\\\"); /* int no2(void); // */
    return sum{k}(1); // int no3(
}
static const char *name{k}(struct part{k} *p, int (*f)(int));
typedef struct part{k} *handle{k};
typedef struct { int a; } pair{k};
enum color{k} { RED{k} };
union value{k} { int i; };
char quote = '"'; int tail{k}(void);
''', "3:part{k} 6:main{k} 12:name{k} 13:handle{k} 14:pair{k} 15:color{k} 16:value{k} 17:tail{k}",
    "-1:part{k} -1:size -1:main{k} -1:argc -1:argv -1:puts -1:sum{k} -1:name{k} -1:part{k} -1:p -1:f "
    "-1:part{k} -1:handle{k} -1:a -1:pair{k} -1:color{k} -1:RED{k} -1:value{k} -1:i -1:quote -1:tail{k}")

_sample("cpp", "cpp", '''\
namespace app {
class Part{k}
    : public Base<int, List<long>> {
 public:
  explicit Part{k}(int size);
  template <typename T>
  std::map<int, std::vector<T>> all{k}(
      const T &x) const;
};
enum class Kind{k} { A };
const char *raw = R"x(int no(int a) { )" class No { )x";
int million = 1'000'000; int after{k}(int a);
int Part{k}::count{k}(
    int x) const {
  std::move(x); /* class No */ return x;
}
Part{k}::Part{k}(int size) : size_(size) {}
struct Box{k} final : Base<Box{k}> { int a; };
typedef int number{k};
}
''', "1:Part{k}@0 4:Part{k}@0,1 6:all{k}@0,1 9:Kind{k}@0 11:after{k}@0 12:count{k}@0 16:Part{k}@0 17:Box{k}@0 18:number{k}@0",
    "-1:app -1:Part{k} -1:Base -1:List -1:Part{k} -1:size -1:T -1:std -1:map -1:std -1:vector -1:T -1:all{k} "
    "-1:T -1:x -1:Kind{k} -1:A -1:raw -1:million -1:after{k} -1:a -1:Part{k} -1:count{k} -1:x -1:std -1:move "
    "-1:x -1:x -1:Part{k} -1:Part{k} -1:size -1:size_ -1:size -1:Box{k} -1:final -1:Base -1:Box{k} -1:a "
    "-1:number{k}")

_sample("java", "java", '''\
public class Part{k}<T extends Comparable<T>>
    extends
    Two{k}
    implements Map<String, List<Integer>>,
    Closeable
{
    public
    static Map<String, List<Map<Integer, String>>>
    names{k}(
        int n, @Named("no(") String s) {
        return find{k}(n);
    }
    <E extends List<List<E>>> E pick{k}(E e) { return new Box{k}<Map<E, E>>(e).open(); }
    String text = """
        class No { void no() {} } " no(1)
        """; char c = '"'; // no(2)
    interface Shape{k}
    {
        double area{k}();
    }
}
''', "0:Part{k} 8:names{k}@0 12:pick{k}@0 16:Shape{k}@0 18:area{k}@0,16", "2:Two{k} 3:Map 4:Closeable 10:find{k} 12:open 12:Box{k}")

_sample("go", "go", '''\
package main
func Add{k}(a int,
	b int) int { return sum{k}(a, b) }
func (
	s *Server{k}) Run{k}() error {
	text := `func No() { " ` + "no(1)" /* func No2() { */
	return s.loop(text) // no(2)
}
type (
	Pair{k} struct { next *Node{k} }
)
type Server{k} struct {
}
''', "1:Add{k} 4:Run{k} 9:Pair{k} 11:Server{k}",
    "1:int 2:int 2:int 2:sum{k} 4:Server{k} 4:error 6:loop 9:Node{k} 11:Server{k}")

_sample("c_sharp", "cs", '''\
namespace App{k}
{
public class Part{k}<T> : Base{k}<Dictionary<string, List<T>>>,
    IThing{k} where T : Item{k}
{
    public async Task<List<int>>
        Load{k}<K>(
        string s)
    {
        var text = $"no(1) {helper.Go{k}(s)} {{no.No(2)}}" + @"c:\\" + """a "x" b.no(3)""";
        Widget{k} w = new Widget{k}(text); /* class No */
        return w.Done(1);
    }
}
interface IThing{k}
    : IOther{k} { }
}
''', "0:App{k} 2:Part{k}@0 6:Load{k}@0,2 14:IThing{k}@0",
    "2:Base{k} 3:IThing{k} 3:T 3:Item{k} 9:Go{k} 10:Widget{k} 10:Widget{k} 11:Done 15:IOther{k}")

_sample("javascript", "js", '''\
class Part{k} extends Base {
  constructor() { init{k}(1); }
  run{k}(
    x = pick(1, two(2)),
    y
  ) {
    return other.stop(x) / 2 / this.half(y);
  }
}
const add{k} = (
  a, b = make(3)
) => a + b;
const quote = /'/; function f{k}() { return /[/"]no(1)/.test("no(2)"); }
const text = `no(3) ${ call{k}(`no(4) ${ deep{k}(5) }`) + "}" } no(6)`; function g{k}() {}
/* function no() { /* */ module.exports.go{k} = async function
  () {};
const o = { pair{k}: (x) => 1, half: x / 2 }; // class No
if (ready{k}(o)) { new App.Widget{k}(o); }
const z = require('z');
''', "0:Part{k} 2:run{k}@0 9:add{k} 12:f{k} 13:g{k} 14:go{k} 16:pair{k}",
    "1:init{k} 3:pick 3:two 6:stop 6:half 10:make 12:test 13:call{k} 13:deep{k} 17:ready{k} 17:App.Widget{k} 17:Widget{k}")

_sample("typescript", "ts", '''\
interface Shape{k} {
  area{k}(
    unit: Unit{k}
  ): number;
}
abstract class Base{k}<T extends Map<string, List<T>>> {
  abstract draw{k}(): void;
  run{k}<K>(s: Shape{k},
    f = (x: number) => pick(x)): Result{k} {
    return new Runner{k}<Map<K, List<K>>>(s, /no: No/);
  }
}
declare function outer{k}(x: Thing{k}): void;
const s = `interface No { ${ new Inside{k}(1) } : No2 }`;
type Alias{k}<T> =
  string;
enum Color{k} { Red }
module Inner{k} { function deep{k}() {} }
''', "0:Shape{k} 0:Shape{k} 1:area{k}@0 5:Base{k} 6:draw{k}@5 7:run{k}@5 12:outer{k} 14:Alias{k} 16:Color{k} 17:Inner{k} 17:deep{k}",
    "2:Unit{k} 7:Shape{k} 8:Result{k} 9:Runner{k} 12:Thing{k} 13:Inside{k}")

_sample("php", "php", '''\
<html>function no() { no(1); }
<?php
class Part{k}
  extends Base
{
  public function run{k}(
    $x, $y
  ) { return helper{k}($x); }
}
$text = <<<EOT
function no2() { no(2); } '
  EOT . "no(3) \\" " . 'no(4)
no(5)'; # no(6)
function make{k}() { return new App\\Part{k}(1); }
$f->go{k}(1); Foo::stop{k} (2); // no(7)
?> class No { <?php last{k}(8);
''', "2:Part{k} 5:run{k}@2 13:make{k}", "7:helper{k} 13:Part{k} 14:go{k} 14:stop{k} 15:last{k}")

_sample("ruby", "rb", '''\
module Web{k}
  class App::Page{k} < Base{k}
    def self.make{k}(
      x
    )
      a = <<~TEXT + %w[no1 (no2)].join{k}
        def no3; "
      TEXT
      b = "no4 #{call{k}("no5 #{deep{k}}")}" if a =~ /no6 "/
      c = %q(no7 (no8) ') + ?" + 'no9' # no10
    end
=begin
def no11; end
=end
    class << Meta::Kind{k}
      alias draw{k} render{k}
    end
  end
end
''', "0:Web{k} 1:Page{k}@0 2:make{k}@0,1 14:Kind{k}@0,1 15:draw{k}@0,1,14",
    "0:Web{k} 1:App 1:Base{k} 2:make{k} 2:make{k} 3:x 5:a 5:join{k} 5:join{k} 8:b 8:call{k} 8:call{k} 8:deep{k} 8:a 9:c"
    " 14:Meta 15:draw{k} 15:render{k}")

_sample("rust", "rs", '''\
pub struct Part{k}<T>(T);
enum Kind{k} { A }
type Id{k} = u32;
trait Draw{k} { fn sketch(&self); }
mod inner{k} {
    pub fn open{k}<T>(
        x: T,
    ) -> [u8; 4] { helper{k}(x) }
}
/* fn no() {} /* nested */ fn no2() {} */
macro_rules! my{k} { () => {} }
impl<T: Into<Vec<Vec<T>>>> Draw{k}
    for Part{k}<T> {
    fn draw{k}<'a>(&'a self) where T: Copy { println!("fn no3() {{ {}", r#"fn no4() { "quoted" no(1)"#); self.go{k}('"'); }
}
impl Part{k}<u8>
{
}
fn
main{k}() { let s = "fn no5() {
    no(2)"; last{k}(s) }
''', "0:Part{k} 1:Kind{k} 2:Id{k} 3:Draw{k} 4:inner{k} 5:open{k}@4 5:open{k}@4 10:my{k} 13:draw{k}@11 13:draw{k}@11 19:main{k}",
    "7:helper{k} 11:Draw{k} 13:println 13:go{k} 15:Part{k} 20:last{k}")

_sample("elixir", "ex", '''\
defmodule App.Part{k} do
  @doc """
  def no(1), do: "x" #{inside{k}(1)}
  """
  alias App.Other{k}
  def run{k}(
        x
      ) when x > 1 do
    ~s(no(2) ") |> clean{k}
    |> Other{k}.save{k}("no(3) #{ deep{k}("no(4)") }")
  end
  defp zero{k}, do: 'no(5)' # no(6)
end
''', "0:App.Part{k} 5:run{k}@0 11:zero{k}@0",
    "0:App.Part{k} 0:defmodule 2:inside{k} 4:App.Other{k} 4:alias 5:def 5:run{k} 8:clean{k} 9:Other{k} 9:save{k} 9:deep{k} 11:defp")

_sample("elm", "elm", '''\
module App.Part{k} exposing
    ( Msg{k}(..)
    , view{k}
    , size{k}
    )
{- type No = {- nested -} No2 -}
type
    Msg{k}
    = Go{k}
    | Stop{k} Int
view{k} :
    Model{k} -> Html{k}
view{k}
    model =
    div{k} (render{k} model) "type No" -- no x
start{k} = Go{k}
''', "0:App.Part{k} 7:Msg{k}@6 8:Go{k}@6 9:Stop{k}@6 12:view{k} 15:start{k}",
    "1:Msg{k} 2:view{k} 3:size{k} 8:Go{k} 10:view{k} 11:Model{k} 11:Html{k} 14:div{k} 14:render{k} 15:Go{k}")

_sample("elisp", "el", '''\
(defun
  greet{k} (name)
  "say (no1) \\" (defun no2"
  (let ((c ?\\")) ; (no3)
    (message{k} name)))
(defsubst two{k} () 2)
(defmacro
  twice{k} (x) x)
''', "1:greet{k}@0 5:two{k} 7:twice{k}@6", "1:name 3:c 4:message{k} 4:name 7:x 7:x")

_sample("ocaml", "ml", '''\
module Part{k} = struct
  let add{k}
      x y = helper{k} x + y
  (* let no1 x = (* nested *) " *) " let no2 x = 2 *)
  let id{k} = fun x -> {s|let no3 x = "|s} ^ "(* no4 x"
end
module type Kind{k} = sig end
external now{k} : unit -> float = "now"
let ( +! ) a b = a
class point{k} = object method move{k} d = d end
let p = new point{k}
let r = Part{k}.add{k} 1 2 |> show{k}
let c = '"' and q = p#move{k}
''', "0:Part{k} 1:add{k}@0 4:id{k}@0 6:Kind{k} 7:now{k} 8:+! 9:point{k} 9:move{k}",
    "2:helper{k} 2:+ 4:^ 10:point{k} 11:Part{k} 11:add{k} 11:|> 11:show{k} 12:move{k}")

_sample("ql", "ql", '''\
module Lib{k} {
}
class Call{k}
  extends Expr{k} {
  string getName{k}(
    int i
  ) { result = this.text{k}() }
}
newtype TNode{k} =
  TLeaf{k}(int i)
/* predicate no(Call c) { } */
predicate isBig{k}(Call{k} c) {
  isLarge{k}(c) and
  isWide{k}("no(1)")
}
''', "0:Lib{k} 2:Call{k} 4:getName{k}@2 8:TNode{k} 9:TLeaf{k} 11:isBig{k}",
    "3:Expr{k} 6:text{k} 11:Call{k} 12:isLarge{k} 13:isWide{k}")
