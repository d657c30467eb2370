"""Grammars of the languages, as text.  Terminals are the token names of :mod:`codeloom.llm.syntax.lexers`.

Operators of all precedences are one class each: precedence does not decide whether a text is well-formed.
"""

JSON = """
file: value
value: STRING | NUMBER | 'true' | 'false' | 'null' | '{' '}' | '{' members '}' | '[' ']' | '[' elements ']'
members: member | members ',' member
member: STRING ':' value
elements: value | elements ',' value
"""

PYTHON = """
file: (NEWLINE | statement)*
statement: simple | compound
simple: small (';' small)* ';'? NEWLINE
small: expr_stmt | 'del' targets | 'pass' | 'break' | 'continue' | 'return' testlist_star? | 'raise' (test ('from' test)?)? | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)*
    | 'assert' test (',' test)? | 'import' dotted_as (',' dotted_as)* | 'from' dots? dotted 'import' imported | 'from' dots 'import' imported | 'type' NAME type_params? '=' test
expr_stmt: testlist_star | target AUGASSIGN (testlist_star | yield_expr) | target ':' test ('=' (testlist_star | yield_expr))? | assigns (testlist_star | yield_expr) | yield_expr
assigns: target_list '=' | assigns target_list '='
target_list: star_target (',' star_target)* ','?
star_target: target | '*' target
target: NAME | primary '.' NAME | primary '[' subscripts ']' | '(' target_list ')' | '(' ')' | '[' target_list? ']' | softname
targets: target_list
dotted_as: dotted ('as' NAME)?
dotted: NAME ('.' NAME)*
dots: ('.' | '...')+
imported: '*' | '(' import_as (',' import_as)* ','? ')' | import_as (',' import_as)*
import_as: NAME ('as' NAME)?
compound: if_stmt | while_stmt | for_stmt | try_stmt | with_stmt | funcdef | classdef | decorated | 'async' (funcdef | for_stmt | with_stmt) | match_stmt
if_stmt: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
while_stmt: 'while' named ':' suite ('else' ':' suite)?
for_stmt: 'for' target_list 'in' testlist_star ':' suite ('else' ':' suite)?
try_stmt: 'try' ':' suite ((except_clause ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
except_clause: 'except' '*'? (test ('as' NAME)? | test (',' test)+)?
with_stmt: 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')') ':' suite
with_item: test ('as' target)?
match_stmt: 'match' testlist_star ':' NEWLINE INDENT case_block+ DEDENT
case_block: 'case' patterns ('if' named)? ':' suite
patterns: star_pattern (',' star_pattern)* ','?
star_pattern: pattern | '*' NAME
pattern: or_pattern ('as' NAME)?
or_pattern: closed_pattern | or_pattern '|' closed_pattern
closed_pattern: '-'? NUMBER (SIGN NUMBER)? | strings | 'None' | 'True' | 'False' | dotted | '(' patterns? ')' | '[' patterns? ']' | '{' (map_pattern (',' map_pattern)* ','?)? '}' | dotted '(' (arg_pattern (',' arg_pattern)* ','?)? ')'
map_pattern: closed_pattern ':' pattern | '**' NAME
arg_pattern: pattern | NAME '=' pattern
decorated: ('@' named NEWLINE)+ (classdef | funcdef | 'async' funcdef)
funcdef: 'def' NAME type_params? '(' params? ')' ('->' test)? ':' suite
type_params: '[' type_param (',' type_param)* ','? ']'
type_param: NAME (':' test)? ('=' test)? | '*' NAME | '**' NAME
params: param (',' param)* ','?
param: NAME (':' test)? ('=' test)? | '*' NAME (':' star_test)? | '*' | '/' | '**' NAME (':' test)?
star_test: test | '*' test
classdef: 'class' NAME type_params? ('(' arguments? ')')? ':' suite
suite: simple | NEWLINE INDENT statement+ DEDENT
named: test | NAME ':=' test
test: or_test | or_test 'if' or_test 'else' test | lambda
lambda: 'lambda' lparams? ':' test
lparams: lparam (',' lparam)* ','?
lparam: NAME ('=' test)? | '*' NAME | '*' | '/' | '**' NAME
or_test: operand | or_test binop operand
binop: BINOP | SIGN | '*' | '**' | '/' | '@' | '|' | COMPARE | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
operand: primary | 'await' primary | unary operand
unary: SIGN | '~' | 'not'
primary: atom | primary '.' NAME | primary '(' arguments? ')' | primary '[' subscripts ']'
arguments: argument (',' argument)* ','?
argument: named | NAME '=' test | '*' test | '**' test | named comp_for
subscripts: subscript (',' subscript)* ','?
subscript: named | '*' test | test? ':' test? (':' test?)?
atom: softname | NUMBER | strings | 'None' | 'True' | 'False' | '...' | '(' (testlist_comp | yield_expr)? ')' | '[' testlist_comp? ']' | '{' (dict_items | set_items)? '}'
softname: NAME
strings: STRING+
testlist_comp: star_named comp_for | star_named (',' star_named)* ','?
star_named: named | '*' or_test
testlist_star: star_expr (',' star_expr)* ','?
star_expr: named_plain | '*' or_test
named_plain: test
dict_items: dict_item (',' dict_item)* ','? | test ':' test comp_for
dict_item: test ':' test | '**' or_test
set_items: star_named (',' star_named)* ','? | star_named comp_for
comp_for: 'async'? 'for' target_list 'in' or_test (comp_for | comp_if)?
comp_if: 'if' or_test_named (comp_for | comp_if)?
or_test_named: or_test | NAME ':=' test | lambda
yield_expr: 'yield' (testlist_star | 'from' test)?
"""

GO = """
file: 'package' NAME ';' (import ';')* (top ';')*
import: 'import' (import_spec | '(' (import_spec (';' import_spec)* ';'?)? ')')
import_spec: ('.' | NAME)? STRING
top: decl | func
decl: 'const' (const_spec | '(' (const_spec (';' const_spec)* ';'?)? ')') | 'var' (var_spec | '(' (var_spec (';' var_spec)* ';'?)? ')') | 'type' (type_spec | '(' (type_spec (';' type_spec)* ';'?)? ')')
const_spec: names (type? '=' exprs)?
var_spec: names (type ('=' exprs)? | '=' exprs)
type_spec: NAME type_params? '='? type
type_params: '[' tparam (',' tparam)* ','? ']'
tparam: names constraint
constraint: '~'? type ('|' '~'? type)*
names: NAME (',' NAME)*
func: 'func' receiver? NAME type_params? signature block?
receiver: params
signature: params result?
result: params | type
params: '(' (param (',' param)* ','?)? ')'
param: NAME? '...'? type
type: NAME | NAME '.' NAME | (NAME | NAME '.' NAME) '[' types ']' | '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'chan' type | '<-' 'chan' type | 'chan' '<-' type | 'func' signature | struct | interface | '(' type ')'
types: type (',' type)* ','?
struct: 'struct' '{' (field (';' field)* ';'?)? '}'
field: (names type | '*'? NAME ('.' NAME)?) STRING?
interface: 'interface' '{' (method (';' method)* ';'?)? '}'
method: NAME signature | constraint
block: '{' statements '}'
statements: statement? | statements ';' statement?
statement: decl | simple_stmt | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if_stmt | switch_stmt | select_stmt | for_stmt | NAME ':' statement?
simple_stmt: expr | expr INCDEC | expr '<-' expr | exprs ASSIGN exprs | exprs '=' exprs | exprs ':=' exprs
if_stmt: 'if' (simple_stmt? ';')? expr block ('else' (if_stmt | block))?
switch_stmt: 'switch' (simple_stmt? ';')? simple_stmt? '{' case* '}'
case: ('case' case_items | 'default') ':' statements
case_items: case_item (',' case_item)*
case_item: expr | type
select_stmt: 'select' '{' comm* '}'
comm: ('case' simple_stmt | 'default') ':' statements
for_stmt: 'for' (expr | simple_stmt? ';' expr? ';' simple_stmt? | (exprs ('=' | ':='))? 'range' expr)? block
exprs: expr (',' expr)*
expr: unary | expr binop unary
binop: BINOP | SIGN | '*' | '&' | '|' | COMPARE | '<-'
unary: primary | unop unary
unop: SIGN | '!' | '^' | '*' | '&' | '<-' | '~'
primary: operand | primary '.' NAME | primary '.' '(' (type | 'type') ')' | primary '[' (expr | type) (',' (expr | type))* ','? ']' | primary '[' expr? ':' expr? (':' expr)? ']' | primary '(' (args ','?)? ')' | lit_type '{' elements? '}'
args: arg (',' arg)*
arg: expr '...'? | arg_type
arg_type: '[' ']' type | 'map' '[' type ']' type | 'chan' type | struct | interface | 'func' signature
operand: NAME | NUMBER | STRING | CHAR | '(' expr ')' | 'func' signature block | conv_type '(' expr ','? ')'
conv_type: '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | interface | 'func' signature
lit_type: NAME | NAME '.' NAME | (NAME | NAME '.' NAME) '[' types ']' | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | struct
elements: element (',' element)* ','?
element: (item ':')? item
item: expr | '{' elements? '}'
"""

C = """
file: top+ | %empty
top: function | declaration | ';' | asm ';'
function: specs? fdeclarator declaration* block
fdeclarator: pointer* fdirect attr*
fdirect: direct '(' params? ')' | direct '(' NAME (',' NAME)* ')' | '(' attr* fdeclarator ')'
declaration: specs (init_decl (',' init_decl)*)? ';' | '_Static_assert' '(' expr (',' strings)? ')' ';'
init_decl: declarator attr* ('=' init)?
specs: qual* core qual*
core: builtin (qual* builtin)* | NAME | record | enum | 'typeof' '(' (expr | type_name) ')' | '_Atomic' '(' type_name ')'
qual: STORAGE | QUAL | attr | '_Alignas' '(' (expr | type_name) ')'
builtin: BUILTIN
attr: '__attribute__' '(' '(' attr_item (',' attr_item)* ')' ')'
attr_item: (NAME | QUAL) ('(' args? ')')? | %empty
record: STRUCT attr* NAME? '{' member* '}' attr* | STRUCT attr* NAME
member: specs (member_decl (',' member_decl)*)? ';' | ';'
member_decl: declarator (':' expr)? attr* | ':' expr
enum: 'enum' NAME? '{' enumerator (',' enumerator)* ','? '}' | 'enum' NAME
enumerator: NAME ('=' expr)?
declarator: pointer* direct
pointer: '*' (QUAL | attr)*
direct: NAME | '(' attr* declarator ')' | direct '[' (STORAGE | QUAL)* (expr | '*')? ']' | direct '(' params? ')' | direct '(' NAME (',' NAME)* ')'
params: param (',' param)* (',' '...')?
param: specs (declarator | abstract)? attr*
abstract: pointer+ | pointer* abstract_direct
abstract_direct: '(' abstract ')' | abstract_direct? '[' (STORAGE | QUAL)* expr? ']' | abstract_direct? '(' params? ')'
type_name: specs abstract?
init: expr | '{' (init_item (',' init_item)* ','?)? '}'
init_item: (designator+ '=')? init
designator: '[' expr ('...' expr)? ']' | '.' NAME
block: '{' item* '}'
item: declaration | statement | function_item
function_item: specs fdeclarator block
statement: block | commas? ';' | 'if' '(' commas ')' statement ('else' statement)? | 'switch' '(' commas ')' statement | 'while' '(' commas ')' statement | 'do' statement 'while' '(' commas ')' ';'
    | 'for' '(' (commas? ';' | declaration) commas? ';' commas? ')' statement | 'goto' NAME ';' | 'continue' ';' | 'break' ';' | 'return' commas? ';' | label statement | label declaration | asm ';'
label: NAME ':' | 'case' expr ('...' expr)? ':' | 'default' ':'
asm: 'asm' QUAL* '(' asm_part* ')'
asm_part: STRING | ':' | ',' | NAME | '(' expr ')' | '[' NAME ']'
commas: assign (',' assign)*
expr: assign
assign: cond | unary (ASSIGN | '=') assign
cond: binary | binary '?' commas? ':' cond
binary: unary | binary binop unary
binop: BINOP | SIGN | '*' | '&' | COMPARE
unary: postfix | INCDEC unary | unop unary | 'sizeof' unary | 'sizeof' '(' type_name ')' | '_Alignof' '(' type_name ')' | '(' type_name ')' unary
unop: SIGN | '*' | '&' | '!' | '~' | '&&'
postfix: primary | postfix '[' commas ']' | postfix '(' args? ')' | postfix ('.' | '->') NAME | postfix INCDEC | '(' type_name ')' '{' (init_item (',' init_item)* ','?)? '}'
args: arg (',' arg)*
arg: assign | type_name
primary: NAME | NUMBER | CHAR | strings | '(' commas ')' | '(' block ')' | '_Generic' '(' assign (',' (type_name | 'default') ':' assign)+ ')'
strings: (STRING | NAME STRING | STRING NAME) STRING*
"""

JAVA = """
file: package? import* top* | modifiers? 'open'? 'module' qname '{' directive* '}'
package: annotation* 'package' qname ';'
import: 'import' 'static'? qname ('.' '*')? ';' | ';'
directive: NAME 'static'? NAME? qname ((NAME | 'with') qname (',' qname)*)? ';'
top: type_decl | ';'
type_decl: class | interface | enum | record | annotation_type
modifiers: (MODIFIER | 'static' | 'default' | 'final' | 'sealed' | annotation)+
annotation: '@' qname ('(' (annotation_args | element)? ')')?
annotation_args: NAME '=' element (',' NAME '=' element)*
element: conditional | annotation | '{' (element (',' element)*)? ','? '}'
qname: NAME ('.' NAME)*
class: modifiers? 'class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? class_body
interface: modifiers? 'interface' NAME tparams? ('extends' types)? ('permits' types)? class_body
annotation_type: modifiers? '@' 'interface' NAME class_body
record: modifiers? 'record' NAME tparams? '(' (param (',' param)*)? ')' ('implements' types)? class_body
enum: modifiers? 'enum' NAME ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant: annotation* NAME ('(' args? ')')? class_body?
class_body: '{' member* '}'
member: ';' | type_decl | field | method | constructor | 'static'? block
field: modifiers? type var (',' var)* ';'
method: modifiers? tparams? annotation* (type | 'void') NAME '(' params? ')' dims ('throws' types)? ('default' element)? (block | ';')
constructor: modifiers? tparams? NAME ('(' params? ')')? ('throws' types)? block
params: param (',' param)*
param: (annotation | 'final')* type annotation* '...'? (NAME dims | 'this' | NAME '.' 'this')
var: NAME dims ('=' init)?
dims: ('[' ']')*
init: expr | '{' (init (',' init)*)? ','? '}'
types: type (',' type)*
type: annotation* (PRIMITIVE | named) (annotation* '[' ']')*
named: segment ('.' annotation* segment)*
segment: NAME targs?
targs: '<' (targ (',' targ)*)? close
targ: type | annotation* '?' (('extends' | 'super') type)?
close: GT | GTA
tparams: '<' tparam (',' tparam)* close
tparam: annotation* NAME ('extends' type ('&' type)*)?
block: '{' statement* '}'
statement: block | ';' | local ';' | type_decl | expr_stmt ';' | NAME ':' statement | 'if' '(' expr ')' statement ('else' statement)? | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
    | 'for' '(' (local | expr_stmts)? ';' expr? ';' expr_stmts? ')' statement | 'for' '(' ((annotation | 'final')* type NAME dims) ':' expr ')' statement
    | 'try' block (catch+ finally? | finally) | 'try' '(' resource (';' resource)* ';'? ')' block catch* finally? | 'switch' '(' expr ')' switch_body | 'synchronized' '(' expr ')' block
    | 'return' expr? ';' | 'throw' expr ';' | 'break' NAME? ';' | 'continue' NAME? ';' | 'assert' expr (':' expr)? ';' | 'yield' expr ';' | NAME expr_y ';'
expr_y: %empty
local: (annotation | 'final')* type var (',' var)*
expr_stmts: expr_stmt (',' expr_stmt)*
expr_stmt: primary (ASSIGN | '=' | GTA (GTA)* '=') expr | INCDEC unary | postfix INCDEC | call | new
catch: 'catch' '(' (annotation | 'final')* type ('|' type)* NAME ')' block
finally: 'finally' block
resource: (annotation | 'final')* type NAME '=' expr | primary
switch_body: '{' (group* | arrow_case+) '}'
group: label+ statement*
label: ('case' case_items | 'default') ':'
arrow_case: ('case' case_items | 'default') '->' (expr ';' | block | 'throw' expr ';')
case_items: case_item (',' case_item)* ('when' expr)?
case_item: conditional | pattern | 'default'
pattern: 'final'? type NAME | type '(' (pattern (',' pattern)*)? ')' NAME?
expr: conditional | lambda | primary (ASSIGN | '=' | GTA (GTA)* '=') expr
lambda: (NAME | '(' ')' | '(' lparam (',' lparam)* ')' | '(' params ')') '->' (expr | block)
lparam: NAME
conditional: binary | binary '?' expr ':' (conditional | lambda)
binary: unary | binary binop unary | binary 'instanceof' ('final'? type NAME? | pattern)
binop: BINOP | SIGN | '*' | '&' | '|' | '<' | GT | GTA GT | GTA GTA GT | GTA '='
unary: postfix | SIGN unary | INCDEC unary | '~' unary | '!' unary | '(' type ('&' type)* ')' unary_cast
unary_cast: unary | lambda
postfix: primary | postfix INCDEC
primary: NAME | literal | '(' expr ')' | 'this' | 'super' | call | new | primary '.' NAME | primary '.' 'this' | primary '.' 'super' | primary '[' expr ']' | PRIMITIVE dims '.' 'class' | primary dims_class '.' 'class' | 'void' '.' 'class'
    | primary '::' targs? (NAME | 'new') | generic_ref '::' targs? (NAME | 'new') | switch_expr | primary '.' 'class'
dims_class: ('[' ']')+
generic_ref: PRIMITIVE ('[' ']')+ | named_generic dims
named_generic: (NAME '.')* NAME targs | named_generic '.' segment
switch_expr: 'switch' '(' expr ')' switch_body
literal: NUMBER | STRING | CHAR | 'true' | 'false' | 'null'
call: (NAME | 'this' | 'super') '(' args? ')' | primary '.' targs? (NAME | 'super' | 'this') '(' args? ')'
args: expr (',' expr)*
new: (primary '.')? 'new' targs? annotation* new_type '(' args? ')' class_body? | 'new' annotation* (PRIMITIVE | named) (('[' expr ']')+ ('[' ']')* | ('[' ']')+ array_init)
new_type: segment ('.' segment)*
array_init: '{' (init (',' init)*)? ','? '}'
"""

SQL = """
file: (statement? ';')* statement?
statement: select_stmt | insert | update | delete | create | drop | alter | transaction | merge | grant | set | call | explain
explain: 'explain' NAME? statement
transaction: ('begin' | 'commit' | 'rollback' | 'start' 'transaction' | 'savepoint' NAME | 'end') ('transaction' | 'work')?
set: 'set' NAME* (qname ('=' | 'to') expr_list | NAME+)
call: 'call' function
grant: ('grant' | 'revoke') grant_word (',' grant_word)* 'on' grant_word* qname ('to' | 'from') NAME (',' NAME)*
grant_word: (NAME | 'select' | 'insert' | 'update' | 'delete' | 'create' | 'references' | 'table' | 'all')+
select_stmt: with? query order? limit?
with: 'with' 'recursive'? cte (',' cte)*
cte: name ('(' names ')')? 'as' (NAME | 'not' NAME)? '(' statement ')'
query: select | '(' select_stmt ')' | query setop ('all' | 'distinct')? (select | '(' select_stmt ')') | 'values' row (',' row)*
setop: 'union' | 'intersect' | 'except'
select: 'select' ('all' | 'distinct' ('on' '(' expr_list ')')?)? (item (',' item)*) ('from' from (',' from)*)? ('where' expr)? ('group' 'by' group_item (',' group_item)*)? ('having' expr)? ('window' window_def (',' window_def)*)? ('qualify' expr)?
group_item: expr | '(' ')' | 'all'
window_def: name 'as' '(' over ')'
item: '*' | qname '.' '*' | expr ('as'? name | 'as' STRING)?
from: source | from join source ('on' expr | 'using' '(' names ')')?
join: 'natural'? ('inner' | ('left' | 'right' | 'full') 'outer'?)? 'join' | 'cross' 'join'
source: 'lateral'? (qname | function | '(' select_stmt ')' | '(' from ')') alias?
alias: 'as'? name ('(' names ')')?
order: 'order' 'by' sort (',' sort)*
sort: expr ('asc' | 'desc')? ('nulls' ('first' | 'last'))?
limit: limit_part+ ('for' 'update')?
limit_part: 'limit' expr (',' expr)? | 'offset' expr ('row' | 'rows')? | 'fetch' ('first' | 'next') expr? ('row' | 'rows') 'only'
insert: with? ('insert' NAME? | 'replace') 'into' qname alias? ('(' names ')')? ('values' row (',' row)* | select_stmt | 'default' 'values' | 'set' assign (',' assign)*) conflict? returning?
conflict: 'on' ('conflict' ('(' names ')')? 'do' ('nothing' | 'update' 'set' assign (',' assign)* ('where' expr)?) | 'duplicate' 'key' 'update' assign (',' assign)*)
returning: 'returning' item (',' item)*
row: '(' (expr_or_default (',' expr_or_default)*)? ')'
expr_or_default: expr | 'default'
update: with? 'update' qname alias? 'set' assign (',' assign)* ('from' from (',' from)*)? ('where' expr)? returning?
assign: (qname | '(' names ')') '=' expr_or_default
delete: with? 'delete' 'from' qname alias? ('using' from (',' from)*)? ('where' expr)? returning?
merge: 'merge' 'into' qname alias? 'using' source 'on' expr when_merge+
when_merge: 'when' 'not'? 'matched' ('and' expr)? 'then' ('update' 'set' assign (',' assign)* | 'delete' | 'insert' ('(' names ')')? 'values' row | 'do' 'nothing')
create: 'create' ('or' 'replace')? create_mod* ('table' exists? qname table_body | 'view' exists? qname ('(' names ')')? 'as' select_stmt ('with' NAME+)? | 'unique'? 'index' NAME? exists? qname? 'on' qname ('using' NAME)? '(' sort (',' sort)* ')' ('where' expr)? | ('schema' | 'database' | 'sequence' | 'type' | 'extension') exists? qname create_rest*)
create_mod: NAME | 'materialized' | 'temporary'
create_rest: NAME | NUMBER | 'as' | 'with' | 'start' | 'by' | '(' expr_list ')' | 'enum'
exists: 'if' 'not' 'exists'
table_body: '(' table_item (',' table_item)* ')' table_opt* | 'as' select_stmt | '(' table_item (',' table_item)* ')' 'as' select_stmt
table_opt: NAME '='? (NAME | NUMBER | STRING)? | 'with' '(' assign (',' assign)* ')' | 'default' NAME '='? NAME | 'partition' 'by' NAME '(' names ')'
table_item: name type column_opt* | constraint | 'like' qname
type: (NAME | 'date' | 'interval') TYPE_WORD* ('(' (NUMBER | NAME) (',' NUMBER)? ')')? TYPE_WORD* ('[' NUMBER? ']')* | 'enum' '(' STRING (',' STRING)* ')' | 'set' '(' STRING (',' STRING)* ')' | NAME ('with' | 'without') NAME NAME | NAME '(' NUMBER ')' ('with' | 'without') NAME NAME
column_opt: 'not'? 'null' | 'default' default_value | 'primary' 'key' ('asc' | 'desc')? | 'unique' | 'check' '(' expr ')' | ref | 'constraint' name | 'generated' ('always' | 'by' 'default') 'as' ('identity' ('(' NAME* ')')? | '(' expr ')' COLUMN_WORD?) | 'collate' NAME | 'comment' STRING | COLUMN_WORD | 'on' 'update' default_value
default_value: primary | SIGN NUMBER | '(' expr ')'
ref: 'references' qname ('(' names ')')? ref_act*
ref_act: 'on' ('delete' | 'update') ('set' ('null' | 'default') | NAME | NAME NAME)
constraint: ('constraint' name)? ('primary' 'key' '(' names ')' | 'unique' 'key'? name? '(' names ')' | 'foreign' 'key' '(' names ')' ref | 'check' '(' expr ')' | ('key' | 'index') name? '(' names ')')
drop: 'drop' ('table' | 'view' | 'index' | 'schema' | 'database' | 'sequence' | 'type' | NAME | 'materialized' 'view') ('if' 'exists')? qname (',' qname)* NAME?
alter: 'alter' ('table' | 'index' | 'view' | 'sequence' | 'schema') ('if' 'exists')? 'only'? qname alter_act (',' alter_act)*
alter_act: 'add' 'column'? exists? table_item | 'drop' ('column' | 'constraint')? ('if' 'exists')? name NAME? | 'alter' 'column'? name alter_col | 'rename' ('column'? name)? 'to' name | ('modify' | 'change') 'column'? name+ type column_opt* | 'set' 'schema' name | 'owner' 'to' name | NAME+ 'to' NAME
alter_col: 'set' ('not' 'null' | 'default' default_value | NAME 'type' type) | 'drop' ('not' 'null' | 'default') | 'type' type ('using' expr)?
name: NAME | TYPE_WORD | COLUMN_WORD | softkey
softkey: 'key' | 'first' | 'last' | 'row' | 'rows' | 'only' | 'type' | 'comment' | 'enum' | 'start' | 'work' | 'temporary' | 'always' | 'identity' | 'duplicate' | 'nothing' | 'matched' | 'owner' | 'change' | 'modify' | 'rename' | 'next' | 'do' | 'replace' | 'schema' | 'sequence' | 'extension' | 'database' | 'transaction' | 'index' | 'view' | 'conflict' | 'returning' | 'nulls' | 'over' | 'filter' | 'partition' | 'range' | 'column' | 'add' | 'generated' | 'collate' | 'savepoint' | 'call' | 'explain' | 'qualify' | 'window' | 'offset' | 'begin' | 'end' | 'commit' | 'rollback' | 'set' | 'date' | 'interval'
names: name (',' name)*
qname: NAME | TYPE_WORD | qname '.' name
expr_list: expr (',' expr)*
expr: predicate | expr ('and' | 'or') predicate
predicate: 'not' predicate | sum | predicate compare sum | predicate 'not'? 'in' '(' (select_stmt | expr_list) ')' | predicate 'not'? 'between' sum 'and' sum | predicate 'not'? ('like' | 'ilike' | 'similar' 'to' | 'rlike' | 'regexp') sum ('escape' STRING)? | predicate 'is' 'not'? ('null' | 'true' | 'false' | 'distinct' 'from' sum | NAME) | 'exists' '(' select_stmt ')'
compare: '=' | COMPARE | COMPARE ('all' | 'any' | 'some') | '=' ('all' | 'any' | 'some')
sum: operand | sum (OP | SIGN | '*') operand
operand: primary | SIGN operand | operand '::' cast_type | operand '[' expr (':' expr)? ']' | primary 'collate' NAME | primary 'at' NAME NAME primary
cast_type: (NAME | 'date' | 'interval') TYPE_WORD* ('(' NUMBER (',' NUMBER)? ')')? ('[' ']')*
primary: NUMBER | STRING+ | 'null' | 'true' | 'false' | qname | function | '(' expr_list ')' | '(' select_stmt ')' | case | 'cast' '(' expr 'as' cast_type ')' | PARAM | 'array' '[' expr_list? ']' | ('interval' | 'date' | NAME) STRING NAME?
function: qname '(' (('distinct' | 'all')? expr_list order? | '*' | expr 'from' expr ('for' expr)?)? ')' ('filter' '(' 'where' expr ')')? ('over' (name | '(' over ')'))? | ('left' | 'right' | 'replace' | 'if' | 'values') '(' expr_list ')'
over: name? ('partition' 'by' expr_list)? order? frame?
frame: ('rows' | 'range' | 'groups') (bound | 'between' bound 'and' bound)
bound: NAME NAME | 'current' 'row' | expr NAME
case: 'case' expr? ('when' expr 'then' expr)+ ('else' expr)? 'end'
"""

#: JavaScript; the parts that only TypeScript has are added below.
_JS = """
file: element*
element: statement | module
module: 'import' import_clause 'from' STRING with? semi | 'import' STRING with? semi | 'export' export_clause
with: ('with' | 'assert') object
import_clause: IDENT_ (',' ('{' import_specs? '}' | '*' 'as' IDENT_))? | '{' import_specs? '}' | '*' 'as' IDENT_
import_specs: import_spec (',' import_spec)* ','?
import_spec: (word 'as' IDENT_ | IDENT_ | STRING 'as' IDENT_)
export_clause: '{' export_specs? '}' ('from' STRING with?)? semi | '*' ('as' word)? 'from' STRING with? semi | declaration | 'default' (function | class | assign semi | 'async' function)
export_specs: export_spec (',' export_spec)* ','?
export_spec: (word | STRING) ('as' (word | STRING))?
semi: ';' | ASI
statement: block | ';' | declaration | exprs semi | 'if' '(' exprs ')' statement ('else' statement)? | 'while' '(' exprs ')' statement | 'do' statement 'while' '(' exprs ')' (semi | %empty)
    | 'for' 'await'? '(' for_head ')' statement | 'continue' IDENT_? semi | 'break' IDENT_? semi | 'return' exprs? semi | 'throw' exprs semi | 'with' '(' exprs ')' statement
    | 'switch' '(' exprs ')' '{' case* '}' | IDENT_ ':' statement | 'try' block (catch finally? | finally) | 'debugger' semi
for_head: (for_decl | exprs)? ';' exprs? ';' exprs? | (LETS | 'const' | 'var') binding ('in' exprs | 'of' assign) | postfix_lhs ('in' exprs | 'of' assign)
for_decl: (LETS | 'const' | 'var') binding_init (',' binding_init)*
case: ('case' exprs | 'default') ':' statement*
catch: 'catch' ('(' binding ')')? block
finally: 'finally' block
block: '{' statement* '}'
declaration: variable semi | function | 'async' function | class
variable: (LETS | 'const' | 'var') binding_init (',' binding_init)*
binding_init: binding ('=' assign)?
binding: IDENT_ | '{' (bind_prop (',' bind_prop)* ','?)? '}' | '[' bind_items ']'
bind_prop: IDENT_ ('=' assign)? | prop_name ':' bind_elem | '...' binding
bind_elem: binding ('=' assign)?
bind_items: bind_item? | bind_items ',' bind_item?
bind_item: bind_elem | '...' binding
function: 'function' '*'? IDENT_? signature block
signature: '(' params? ')'
params: param (',' param)* ','?
param: '...'? binding ('=' assign)?
class: decorator* 'class' IDENT_? heritage '{' class_item* '}'
decorator: '@' decorator_expr
decorator_expr: IDENT_ | decorator_expr '.' word | decorator_expr '(' args? ')' | '(' exprs ')'
heritage: ('extends' postfix_lhs)?
class_item: ';' | decorator* 'static'? method | decorator* 'static'? field semi | 'static' block
field: class_name ('=' assign)?
method: ('get' | 'set' | 'async'? '*'?) class_name signature block
class_name: prop_name | PRIVATE
prop_name: word | STRING | NUMBER | '[' assign ']'
exprs: assign | exprs ',' assign
assign: cond | arrow | postfix_lhs (ASSIGN | '=' | GTA (GTA)* '=') assign | yield
yield: 'yield' ('*'? assign)?
arrow: 'async'? (IDENT_ | signature) '=>' (assign | block)
cond: binary | binary '?' assign ':' assign
binary: unary | binary binop unary | PRIVATE 'in' unary
binop: BINOP | SIGN | '*' | '<' | GT | GTA GT | GTA GTA GT | GTA '=' | '&' | '|' | 'in' | 'instanceof'
unary: postfix | unop unary | INCDEC unary | 'await' unary
unop: SIGN | '!' | '~' | 'typeof' | 'void' | 'delete'
postfix: postfix_lhs | postfix_lhs POSTFIX
postfix_lhs: primary | postfix_lhs '.' (word | PRIVATE) | postfix_lhs '?.' (word | PRIVATE | '[' exprs ']' | '(' args? ')') | postfix_lhs '[' exprs ']' | postfix_lhs '(' args? ')' | postfix_lhs template | 'new' new_target | 'import' '(' assign (',' assign)? ','? ')' | 'import' '.' word | 'super' '(' args? ')' | 'super' '.' word | 'super' '[' exprs ']'
new_target: new_callee ('(' args? ')')? | '.' word
new_callee: primary | new_callee '.' (word | PRIVATE) | new_callee '[' exprs ']' | 'new' new_target
args: arg (',' arg)* ','?
arg: '...'? assign
primary: IDENT_ | 'this' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | template | '(' exprs ')' | '[' array_items ']' | object | function | 'async' function | class
array_items: array_item? | array_items ',' array_item?
array_item: '...'? assign
object: '{' (property (',' property)* ','?)? '}'
property: IDENT_ ('=' assign)? | prop_name ':' assign | '...' assign | method
template: TEMPLATE | TEMPLATE_HEAD exprs (TEMPLATE_MID exprs)* TEMPLATE_TAIL
IDENT_: NAME | SOFT | LETS | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from'
word: IDENT_ | KEYWORD_
KEYWORD_: 'import' | 'export' | 'default' | 'if' | 'else' | 'while' | 'do' | 'for' | 'continue' | 'break' | 'return' | 'throw' | 'with' | 'switch' | 'case' | 'try' | 'catch' | 'finally' | 'debugger' | 'const' | 'var' | 'function' | 'class' | 'extends' | 'yield' | 'in' | 'instanceof' | 'await' | 'typeof' | 'void' | 'delete' | 'new' | 'super' | 'this' | 'null' | 'true' | 'false' | 'enum'
"""
JAVASCRIPT = _JS + """
LETS: 'let'
"""
_SOFT_TS = "'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'keyof' | 'infer' | 'is' | 'asserts' | 'public' | 'private' | 'protected' | 'override' | 'satisfies' | 'unique' | 'global' | 'implements' | 'assert' | 'out' | 'accessor'"
TYPESCRIPT = (
    _JS
    + f"""
LETS: 'let'
SOFT: {_SOFT_TS}
"""
    + """
module: 'import' 'type' import_clause 'from' STRING semi | 'export' 'type' ('{' export_specs? '}' ('from' STRING)? semi | '*' ('as' word)? 'from' STRING semi) | 'export' '=' assign semi | 'import' 'type'? IDENT_ '=' ('require' '(' STRING ')' | entity) semi | 'export' 'as' 'namespace' IDENT_ semi | 'export' 'default' interface
import_spec: 'type' word ('as' IDENT_)?
export_spec: 'type' word ('as' word)?
declaration: interface | alias semi | enum | 'declare' declaration | namespace | 'abstract' class | 'declare' 'global' block_elements | overload semi | 'async' overload semi
interface: 'interface' IDENT_ tparams? ('extends' type_ref (',' type_ref)*)? object_type
alias: 'type' IDENT_ tparams? '=' type
enum: 'const'? 'enum' IDENT_ '{' (enum_item (',' enum_item)* ','?)? '}'
enum_item: prop_name ('=' assign)?
namespace: ('namespace' | 'module') (entity | STRING) block_elements
block_elements: '{' element* '}'
overload: 'function' '*'? IDENT_ signature
binding_init: binding '!'? ':' type ('=' assign)?
param: param_mod* '...'? (binding | 'this') '?'? (':' type)? ('=' assign)?
param_mod: 'public' | 'private' | 'protected' | 'readonly' | 'override' | decorator
signature: tparams? '(' params? ')' (':' return_type)?
return_type: type | 'asserts'? (IDENT_ | 'this') 'is' type | 'asserts' (IDENT_ | 'this')
catch: 'catch' '(' binding ':' type ')' block
heritage: 'extends' postfix_lhs targs ('implements' type_ref (',' type_ref)*)? | ('extends' postfix_lhs)? 'implements' type_ref (',' type_ref)*
class: decorator* 'class' IDENT_ tparams heritage '{' class_item* '}'
class_item: decorator* member_mod+ method | decorator* member_mod+ field semi | decorator* member_mod* method_head semi | member_mod* index_signature semi
member_mod: 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'override' | 'declare' | 'accessor'
method_head: ('get' | 'set' | 'async'? '*'?) class_name '?'? signature
method: ('async'? '*'?) class_name '?' signature block
field: class_name ('?' | '!')? (':' type)? ('=' assign)?
index_signature: '[' IDENT_ ':' type ']' ':' type
binary: binary ('as' | 'satisfies') (type | 'const')
unary: '<' (type | 'const') close unary
postfix_lhs: postfix_lhs '!' | postfix_lhs targs '(' args? ')' | postfix_lhs '?.' targs '(' args? ')' | postfix_lhs targs template
new_target: new_callee targs ('(' args? ')')?
targs: '<' type (',' type)* close
close: GT | GTA
tparams: '<' tparam (',' tparam)* ','? close
tparam: ('const' | 'in' | 'out')* IDENT_ ('extends' type)? ('=' type)?
type: union | function_type | union 'extends' type '?' type ':' type
function_type: 'abstract'? 'new'? tparams? '(' params? ')' '=>' return_type
union: '|'? inter ('|' inter)*
inter: '&'? unary_type ('&' unary_type)*
unary_type: postfix_type | ('keyof' | 'unique' | 'readonly' | 'infer') unary_type | '(' function_type ')'
postfix_type: simple_type | postfix_type '[' ']' | postfix_type '[' type ']'
simple_type: type_ref | 'void' | 'null' | 'true' | 'false' | 'this' | STRING | SIGN? NUMBER | template_type | object_type | '[' (tuple_item (',' tuple_item)* ','?)? ']' | '(' type ')' | 'typeof' entity targs? | 'typeof'? 'import' '(' STRING ')' ('.' entity)? targs?
template_type: TEMPLATE | TEMPLATE_HEAD type (TEMPLATE_MID type)* TEMPLATE_TAIL
tuple_item: '...'? type '?'? | '...'? IDENT_ '?'? ':' type
type_ref: entity targs?
entity: IDENT_ | entity '.' word
object_type: '{' members? '}'
members: member ((';' | ',' | ASI) member)* (';' | ',' | ASI)?
member: member_head '?'? (':' type)? | member_head? '?'? signature | 'new' signature | '[' IDENT_ ':' type ']' ':' type | mapped | ('get' | 'set') prop_name signature
member_head: 'readonly'? prop_name
mapped: (SIGN? 'readonly')? '[' IDENT_ 'in' type ('as' type)? ']' (SIGN? '?')? ':' type
property: IDENT_ '!'? 
"""
)
