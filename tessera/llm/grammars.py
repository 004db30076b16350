"""Grammars of the supported languages, as EBNF for tessera.llm.gll.

They decide whether a text is a sentence of the language, not its meaning: binary operators are one flat chain, for
precedence doesn't change which texts are valid, and targets of assignments are expressions. Dialects of a language are
start symbols that run together.
"""

PYTHON = """
File = { NEWLINE | Stmt } ;
Stmt = Simple | Compound ;
Simple = Small { ';' Small } [ ';' ] NEWLINE ;
Name = NAME | 'match' | 'case' | 'type' ;
Small = 'pass' | 'break' | 'continue' | 'return' [ Exprs ] | 'raise' [ Test [ 'from' Test ] ] | 'global' Name { ',' Name }
  | 'nonlocal' Name { ',' Name } | 'del' Exprs | 'assert' Test [ ',' Test ] | 'import' DottedAs { ',' DottedAs }
  | 'from' FromPart 'import' ( '*' | '(' AsName { ',' AsName } [ ',' ] ')' | AsName { ',' AsName } )
  | Exprs [ ':' Test [ '=' Value ] | AUG Value | '=' Value { '=' Value } ] | Yield { '=' Value }
  | 'type' Name [ TypeParams ] '=' Test ;
Value = Yield | Exprs ;
Dotted = Name { '.' Name } ;
DottedAs = Dotted [ 'as' Name ] ;
AsName = Name [ 'as' Name ] ;
FromPart = ( '.' | '...' ) { '.' | '...' } [ Dotted ] | Dotted ;
Yield = 'yield' [ 'from' Test | Exprs ] ;
Exprs = ExprOrStar { ',' ExprOrStar } [ ',' ] | ExprOrStar ',' ;
ExprOrStar = NamedTest | '*' Flat ;
NamedTest = Test [ ':=' Test ] ;
Test = Or [ 'if' Or 'else' Test ] | Lambda ;
Lambda = 'lambda' [ LambdaArgs ] ':' Test ;
LambdaArgs = LambdaArg { ',' LambdaArg } [ ',' ] ;
LambdaArg = Name [ '=' Test ] | '*' [ Name ] | '**' Name | '/' ;
Or = { 'not' } Flat { ( 'and' | 'or' ) { 'not' } Flat | Compare { 'not' } Flat } ;
Compare = CMP | 'in' | 'not' 'in' | 'is' [ 'not' ] ;
Flat = Unary { ( BIN | '|' | '*' | '**' | '-' | '+' | '/' | '@' ) Unary } ;
Unary = { '-' | '+' | '~' } [ 'await' ] Primary ;
Primary = Atom { '.' Name | '(' [ Args ] ')' | '[' Slices ']' } ;
Atom = Name | NUMBER | STRING { STRING } | '...' | 'None' | 'True' | 'False' | '(' [ Yield | Inner ] ')' | '[' [ Inner ] ']' | '{' [ DictOrSet ] '}' ;
Inner = ExprOrStar ( CompFor | { ',' ExprOrStar } [ ',' ] ) ;
CompFor = [ 'async' ] 'for' Targets 'in' CompSource { 'if' CompCond } [ CompFor ] ;
CompSource = Or [ 'if' Or 'else' Test ] | Lambda ;
CompCond = Or [ ':=' Test ] | Lambda ;
Targets = Target { ',' Target } [ ',' ] ;
Target = [ '*' ] Flat ;
DictOrSet = ( Test ':' Test | '**' Flat ) ( CompFor | { ',' ( Test ':' Test | '**' Flat ) } [ ',' ] ) | ExprOrStar ( CompFor | { ',' ExprOrStar } [ ',' ] ) ;
Args = Arg { ',' Arg } [ ',' ] ;
Arg = NamedTest [ CompFor ] | Name '=' Test | '*' Test | '**' Test ;
Slices = Slice { ',' Slice } [ ',' ] ;
Slice = NamedTest | '*' Flat | [ Test ] ':' [ Test ] [ ':' [ Test ] ] ;
Suite = Simple | NEWLINE INDENT { NEWLINE } Stmt { Stmt | NEWLINE } DEDENT ;
Compound = If | While | For | Try | With | { Decorator } Definition | 'async' ( Def | For | With ) | Match ;
Decorator = '@' NamedTest NEWLINE { NEWLINE } ;
Definition = Def | Class | 'async' Def ;
Def = 'def' Name [ TypeParams ] '(' [ Params ] ')' [ '->' Exprs ] ':' Suite ;
TypeParams = '[' TypeParam { ',' TypeParam } [ ',' ] ']' ;
TypeParam = [ '*' | '**' ] Name [ ':' Test ] [ '=' ExprOrStar ] ;
Params = Param { ',' Param } [ ',' ] ;
Param = Name [ ':' Test ] [ '=' Test ] | '*' [ Name [ ':' ExprOrStar ] ] | '**' Name [ ':' Test ] | '/' ;
Class = 'class' Name [ TypeParams ] [ '(' [ Args ] ')' ] ':' Suite ;
If = 'if' NamedTest ':' Suite { 'elif' NamedTest ':' Suite } [ 'else' ':' Suite ] ;
While = 'while' NamedTest ':' Suite [ 'else' ':' Suite ] ;
For = 'for' Targets 'in' Exprs ':' Suite [ 'else' ':' Suite ] ;
Try = 'try' ':' Suite ( Except { Except } [ 'else' ':' Suite ] [ 'finally' ':' Suite ] | 'finally' ':' Suite ) ;
Except = 'except' [ '*' ] [ Test { ',' Test } [ 'as' Name ] ] ':' Suite ;
With = 'with' ( WithItem { ',' WithItem } | '(' WithItem { ',' WithItem } [ ',' ] ')' ) ':' Suite ;
WithItem = Test [ 'as' Target ] ;
Match = 'match' Exprs ':' NEWLINE INDENT Case { Case } DEDENT ;
Case = 'case' Patterns [ 'if' NamedTest ] ':' Suite ;
Patterns = PatternOrStar { ',' PatternOrStar } [ ',' ] ;
PatternOrStar = Pattern | '*' Name ;
Pattern = Closed { '|' Closed } [ 'as' Name ] ;
Closed = [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] | STRING { STRING } | 'None' | 'True' | 'False' | Dotted [ '(' [ PatternArg { ',' PatternArg } [ ',' ] ] ')' ]
  | '(' [ Patterns ] ')' | '[' [ Patterns ] ']' | '{' [ MapItem { ',' MapItem } [ ',' ] ] '}' ;
PatternArg = Pattern | Name '=' Pattern ;
MapItem = ( [ '-' ] NUMBER | STRING { STRING } | 'None' | 'True' | 'False' | Dotted ) ':' Pattern | '**' Name ;
"""

GO = """
File = 'package' NAME ';' { ImportDecl ';' } { TopDecl ';' } ;
Classic = 'package' NAME ';' { ImportDecl ';' } { ClassicDecl ';' } ;
ImportDecl = 'import' ( ImportSpec | '(' { ImportSpec ';' } [ ImportSpec ] ')' ) ;
ImportSpec = [ NAME | '.' ] STRING ;
TopDecl = Decl | 'func' [ Params ] NAME [ TypeParams ] Signature [ Block ] ;
ClassicDecl = Decl | 'func' [ Params ] NAME Signature [ Block ] ;
Decl = 'const' ( ConstSpec | '(' { ConstSpec ';' } [ ConstSpec ] ')' ) | 'var' ( VarSpec | '(' { VarSpec ';' } [ VarSpec ] ')' ) | 'type' ( TypeSpec | '(' { TypeSpec ';' } [ TypeSpec ] ')' ) ;
ConstSpec = NAME { ',' NAME } [ [ Type ] '=' Exprs ] ;
VarSpec = NAME { ',' NAME } ( Type [ '=' Exprs ] | '=' Exprs ) ;
TypeSpec = NAME [ TypeParams ] [ '=' ] Type ;
TypeParams = '[' TypeParam { ',' TypeParam } [ ',' ] ']' ;
TypeParam = NAME { ',' NAME } Constraint ;
Constraint = ConstraintTerm { '|' ConstraintTerm } ;
ConstraintTerm = [ '~' ] Type ;
Signature = Params [ Result ] ;
Result = Params | Type ;
Params = '(' [ Param { ',' Param } [ ',' ] ] ')' ;
Param = NAME [ [ '...' ] Type ] | [ '...' ] Type ;
Type = NAME [ '.' NAME ] [ '[' Type { ',' Type } [ ',' ] ']' ] | '*' Type | '[' ( ']' | '...' ']' | Expr ']' ) Type | 'map' '[' Type ']' Type
  | 'chan' [ '<-' ] Type | '<-' 'chan' Type | 'func' Signature | Struct | Interface | '(' Type ')' ;
Struct = 'struct' '{' { Field ';' } [ Field ] '}' ;
Field = ( NAME { ',' NAME } Type | [ '*' ] NAME [ '.' NAME ] [ '[' Type { ',' Type } ']' ] ) [ STRING ] ;
Interface = 'interface' '{' { Elem ';' } [ Elem ] '}' ;
Elem = NAME Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = { Stmt ';' | ';' } [ Stmt ] ;
Stmt = Decl | SimpleStmt | NAME ':' [ Stmt ] | 'go' Expr | 'defer' Expr | 'return' [ Exprs ] | 'break' [ NAME ] | 'continue' [ NAME ] | 'goto' NAME | 'fallthrough'
  | Block | If | Switch | Select | For ;
SimpleStmt = Exprs [ ':=' Exprs | '=' Exprs | AUG Exprs | '++' | '--' | '<-' Expr ] ;
If = 'if' [ [ SimpleStmt ] ';' ] Expr Block [ 'else' ( If | Block ) ] ;
Switch = 'switch' [ SimpleStmt ] [ ';' [ SimpleStmt ] ] '{' { Case } '}' ;
Case = ( 'case' TypeOrExpr { ',' TypeOrExpr } | 'default' ) ':' Stmts ;
Select = 'select' '{' { ( 'case' SimpleStmt | 'default' ) ':' Stmts } '}' ;
For = 'for' [ Expr | [ SimpleStmt ] ';' [ Expr ] ';' [ SimpleStmt ] | [ Exprs ( '=' | ':=' ) ] 'range' Expr ] Block ;
Exprs = Expr { ',' Expr } ;
Expr = Unary { ( BIN | '*' | '-' | '+' | '<-' | '|' | '&' | '^' ) Unary } ;
Unary = { '-' | '+' | '!' | '^' | '*' | '&' | '<-' | '~' } Primary ;
Primary = Operand { Suffix } ;
Operand = NAME | NUMBER | STRING | CHAR | '(' TypeOrExpr ')' | 'func' Signature [ Block ] | '[' ( ']' | '...' ']' | Expr ']' ) Type | 'map' '[' Type ']' Type | 'chan' [ '<-' ] Type | Struct | Interface ;
Suffix = '.' ( NAME | '(' ( Type | 'type' ) ')' ) | '[' ( TypeOrExpr { ',' TypeOrExpr } [ ',' ] | [ Expr ] ':' [ Expr ] [ ':' Expr ] ) ']' | '(' [ Args ] ')' | Literal ;
Args = TypeOrExpr { ',' TypeOrExpr } [ '...' ] [ ',' ] ;
TypeOrExpr = Expr | '<-' 'chan' Type ;
Literal = '{' [ Element { ',' Element } [ ',' ] ] '}' ;
Element = ( Expr | Literal ) [ ':' ( Expr | Literal ) ] ;
"""

JAVASCRIPT = """
End = ';' | INSERTED ;
Script = { Statement } ;
Module = { ModuleItem } ;
Id = NAME | 'let' | 'static' | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'yield' | 'await' | 'target' | 'accessor' ;
Word = Id | RESERVED | 'var' | 'const' | 'function' | 'class' | 'extends' | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch'
  | 'finally' | 'switch' | 'case' | 'default' | 'new' | 'typeof' | 'in' | 'instanceof' | 'this' | 'super' | 'import' | 'export' | 'with' | 'debugger' | 'null' | 'true' | 'false' | 'void' | 'delete' ;
ModuleItem = Statement | 'import' ( STRING | ImportClause 'from' STRING ) [ 'with' Object ] End | Export ;
ImportClause = Id [ ',' ( '*' 'as' Id | Named ) ] | '*' 'as' Id | Named ;
Named = '{' [ NamedItem { ',' NamedItem } [ ',' ] ] '}' ;
NamedItem = ( Word | STRING ) [ 'as' ( Word | STRING ) ] ;
Export = 'export' ( '*' [ 'as' ( Word | STRING ) ] 'from' STRING [ 'with' Object ] End | Named [ 'from' STRING [ 'with' Object ] ] End | VarStatement | Declaration | 'default' ( Function | Class | Assign End ) ) ;
Declaration = Function | Class ;
Statement = Block | VarStatement | ';' | If | Loop | 'continue' [ Id ] End | 'break' [ Id ] End | 'return' [ Expr ] End | 'with' '(' Expr ')' Statement | Switch | 'throw' Expr End | Try | 'debugger' End | Declaration
  | Id ':' Statement | Expr End ;
Block = '{' { Statement } '}' ;
VarStatement = ( 'var' | 'let' | 'const' ) Binding { ',' Binding } End ;
Binding = ( Id | Pattern ) [ '=' Assign ] ;
Pattern = Object | Array ;
If = 'if' '(' Expr ')' Statement [ 'else' Statement ] ;
Loop = 'do' Statement 'while' '(' Expr ')' [ ';' ] | 'while' '(' Expr ')' Statement | 'for' [ 'await' ] '(' ForHead ')' Statement ;
ForHead = [ ( 'var' | 'let' | 'const' ) Binding { ',' Binding } | Expr ] ';' [ Expr ] ';' [ Expr ] | [ 'var' | 'let' | 'const' ] ( Id | Pattern | Left ) ( 'of' Assign | 'in' Expr ) ;
Switch = 'switch' '(' Expr ')' '{' { ( 'case' Expr | 'default' ) ':' { Statement } } '}' ;
Try = 'try' Block ( 'catch' [ '(' ( Id | Pattern ) ')' ] Block [ 'finally' Block ] | 'finally' Block ) ;
Function = [ 'async' ] 'function' [ '*' ] [ Id ] Params Block ;
Params = '(' [ Param { ',' Param } [ ',' ] ] ')' ;
Param = [ '...' ] ( Id | Pattern ) [ '=' Assign ] ;
Class = 'class' [ Id ] [ 'extends' Left ] '{' { ';' | Member } '}' ;
Member = [ 'static' ] ( [ 'async' ] [ '*' ] PropName Params Block | ( 'get' | 'set' ) PropName Params Block | [ 'accessor' ] PropName [ '=' Assign ] End ) | 'static' Block ;
PropName = Word | STRING | NUMBER | PRIVATE | '[' Assign ']' ;
Expr = Assign { ',' Assign } ;
Assign = Arrow | 'yield' [ [ '*' ] Assign ] | Conditional [ ( '=' | AUG ) Assign ] ;
Arrow = [ 'async' ] ( Id | Params ) '=>' ( Block | Assign ) ;
Conditional = Binary [ '?' Assign ':' Assign ] ;
Binary = Unary { ( BIN | '*' | '+' | '-' | 'in' | 'instanceof' ) Unary } ;
Unary = { 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' | '++n' | '--n' } ( Left [ '++' | '--' ] | PRIVATE ) ;
Left = ( Atom | 'new' NewTail | 'super' | 'import' ) { Access } ;
NewTail = '.' 'target' | 'new' NewTail | ( Atom | 'super' | 'import' ) { '.' ( Word | PRIVATE ) | '[' Expr ']' } ;
Access = ( '.' | '?.' ) ( Word | PRIVATE ) | [ '?.' ] '[' Expr ']' | [ '?.' ] '(' [ Arg { ',' Arg } [ ',' ] ] ')' | Template ;
Arg = [ '...' ] Assign ;
Atom = Id | 'this' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | Template | Array | Object | Function | Class | '(' Expr ')' ;
Template = TEMPLATE | TEMPLATE_HEAD Expr { TEMPLATE_MIDDLE Expr } TEMPLATE_TAIL ;
Array = '[' { ',' } [ Arg { ',' { ',' } Arg } { ',' } ] ']' ;
Object = '{' [ Property { ',' Property } [ ',' ] ] '}' ;
Property = '...' Assign | Id [ '=' Assign ] | PropName ':' Assign | [ 'async' ] [ '*' ] PropName Params Block | ( 'get' | 'set' ) PropName Params Block ;
"""

JAVA = """
Unit = [ Package ] { Import | ';' } { TypeDecl | ';' } ;
Modular = { Import | ';' } { Annotation } [ 'open' ] 'module' Qualified '{' { Directive } '}' ;
Directive = 'requires' { 'transitive' | 'static' } Qualified ';' | ( 'exports' | 'opens' ) Qualified [ 'to' Qualified { ',' Qualified } ] ';' | 'uses' Qualified ';' | 'provides' Qualified 'with' Qualified { ',' Qualified } ';' ;
Id = NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'open' | 'module' | 'requires' | 'transitive' | 'exports' | 'opens' | 'to' | 'uses' | 'provides' | 'with' | 'when' | 'non' ;
Package = { Annotation } 'package' Qualified ';' ;
Import = 'import' [ 'static' ] Qualified [ '.' '*' ] ';' ;
Qualified = Id { '.' Id } ;
Annotation = '@' Qualified [ '(' [ AnnotationArg { ',' AnnotationArg } ] ')' ] ;
AnnotationArg = Id '=' ElementValue | ElementValue ;
ElementValue = Ternary | Annotation | '{' [ ElementValue { ',' ElementValue } ] [ ',' ] '}' ;
Modifier = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' ;
TypeDecl = { Modifier } ( Class | Interface | Enum | Record | AnnotationDecl ) ;
Class = 'class' Id [ TypeParams ] [ 'extends' Type ] [ 'implements' Types ] [ 'permits' Types ] ClassBody ;
Interface = 'interface' Id [ TypeParams ] [ 'extends' Types ] [ 'permits' Types ] ClassBody ;
Enum = 'enum' Id [ 'implements' Types ] '{' [ EnumConst { ',' EnumConst } ] [ ',' ] [ ';' { Member } ] '}' ;
EnumConst = { Annotation } Id [ Arguments ] [ ClassBody ] ;
Record = 'record' Id [ TypeParams ] '(' [ Parameter { ',' Parameter } ] ')' [ 'implements' Types ] ClassBody ;
AnnotationDecl = '@' 'interface' Id ClassBody ;
ClassBody = '{' { Member } '}' ;
Member = ';' | [ 'static' ] Block | TypeDecl | { Modifier } ( [ TypeParams ] ( Type | 'void' ) Id Params Dims Throws ( Block | [ 'default' ElementValue ] ';' ) | Type Declarator { ',' Declarator } ';' | [ TypeParams ] Id Params Throws Block | Id Block ) ;
Throws = [ 'throws' Types ] ;
Params = '(' [ Parameter { ',' Parameter } ] ')' ;
Parameter = { 'final' | Annotation } Type { Annotation } [ '...' ] ( Id Dims | [ Id '.' ] 'this' ) ;
Declarator = Id Dims [ '=' Init ] ;
Init = Expr | ArrayInit ;
ArrayInit = '{' [ Init { ',' Init } ] [ ',' ] '}' ;
Dims = { { Annotation } '[' ']' } ;
Types = Type { ',' Type } ;
TypeParams = '<' TypeParam { ',' TypeParam } '>' ;
TypeParam = { Annotation } Id [ 'extends' Type { '&' Type } ] ;
Type = { Annotation } ( PRIMITIVE | Id [ TypeArgs ] { '.' { Annotation } Id [ TypeArgs ] } ) Dims ;
TypeArgs = '<' [ TypeArg { ',' TypeArg } ] '>' ;
TypeArg = Type | { Annotation } '?' [ ( 'extends' | 'super' ) Type ] ;
Block = '{' { BlockStatement } '}' ;
BlockStatement = LocalVar ';' | TypeDecl | Statement ;
LocalVar = { 'final' | Annotation } Type Declarator { ',' Declarator } ;
Statement = Block | ';' | 'if' '(' Expr ')' Statement [ 'else' Statement ] | 'while' '(' Expr ')' Statement | 'do' Statement 'while' '(' Expr ')' ';'
  | 'for' '(' ( [ LocalVar | Exprs ] ';' [ Expr ] ';' [ Exprs ] | { 'final' | Annotation } Type Id Dims ':' Expr ) ')' Statement
  | 'switch' '(' Expr ')' SwitchBody | 'return' [ Expr ] ';' | 'break' [ Id ] ';' | 'continue' [ Id ] ';' | 'yield' Expr ';' | 'throw' Expr ';' | 'assert' Expr [ ':' Expr ] ';'
  | 'synchronized' '(' Expr ')' Block | Try | Id ':' Statement | StatementExpr ';' ;
StatementExpr = Start { Selector } ( Arguments | '++' | '--' | ( '=' | AUG | '>' '>=' | '>' '>' '>=' ) Expr ) | ( '++' | '--' ) Unary | New ;
Try = 'try' ( '(' Resource { ';' Resource } [ ';' ] ')' Block { Catch } [ 'finally' Block ] | Block ( Catch { Catch } [ 'finally' Block ] | 'finally' Block ) ) ;
Resource = LocalVar | Expr ;
Catch = 'catch' '(' { 'final' | Annotation } Type { '|' Type } Id ')' Block ;
SwitchBody = '{' { Label ':' { Label ':' } { BlockStatement } } '}' | '{' { Label '->' ( Expr ';' | Block | 'throw' Expr ';' ) } '}' ;
Label = 'case' CaseItem { ',' CaseItem } [ 'when' Expr ] | 'default' ;
CaseItem = Ternary | Pattern | 'default' ;
Pattern = { 'final' | Annotation } Type Id | Type '(' [ Pattern { ',' Pattern } ] ')' [ Id ] ;
Exprs = Expr { ',' Expr } ;
Expr = Lambda | Ternary [ ( '=' | AUG | '>' '>=' | '>' '>' '>=' ) Expr ] ;
Lambda = ( Id | '(' [ LambdaParam { ',' LambdaParam } ] ')' ) '->' ( Expr | Block ) ;
LambdaParam = Id | Parameter ;
Ternary = Binary [ '?' Expr ':' ( Ternary | Lambda ) ] ;
Binary = Unary { Operator Unary | 'instanceof' ( Type | Pattern ) } ;
Operator = BIN | '*' | '+' | '-' | '&' | '|' | '<' | '>' | '>=' | '>' '>' [ '>' ] ;
Unary = { '+' | '-' | '!' | '~' | '++' | '--' | Cast } ( Primary { '++' | '--' } | Lambda ) ;
Cast = '(' Type { '&' Type } ')' ;
Primary = Start { Selector } ;
Start = Id | LITERAL | 'this' | 'super' | '(' Expr ')' | New | 'switch' '(' Expr ')' SwitchBody | PRIMITIVE Dims ( '.' 'class' | '::' [ TypeArgs ] 'new' ) | 'void' '.' 'class' | Id TypeArgs { '.' Id [ TypeArgs ] } Dims '::' [ TypeArgs ] ( Id | 'new' ) | Qualified '[' ']' Dims ( '.' 'class' | '::' [ TypeArgs ] 'new' ) ;
Selector = '.' ( [ TypeArgs ] Id | 'this' | 'super' | 'class' | New ) | Arguments | '[' Expr ']' | '::' [ TypeArgs ] ( Id | 'new' ) ;
Arguments = '(' [ Exprs ] ')' ;
New = 'new' [ TypeArgs ] { Annotation } ( PRIMITIVE | Id [ TypeArgs ] { '.' Id [ TypeArgs ] } ) ( Arguments [ ClassBody ] | '[' Expr ']' { '[' Expr ']' } Dims | '[' ']' Dims ArrayInit ) ;
"""

RUST = """
File = { InnerAttr } { Item } ;
Id = NAME | 'union' | 'auto' | 'macro_rules' | 'default' | 'raw' | 'safe' ;
Later = { InnerAttr } { Item } ;
InnerAttr = '#' '!' '[' Tokens ']' ;
Attr = '#' '[' Tokens ']' ;
Tokens = { ANY | Tree } ;
Tree = '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' ;
Vis = 'pub' [ '(' ( 'crate' | 'self' | 'super' | 'in' Path ) ')' ] ;
Item = { Attr } ( [ Vis ] Bare | MacroItem ) ;
Bare = 'mod' Id ( ';' | '{' { InnerAttr } { Item } '}' ) | 'extern' 'crate' ( Id | 'self' ) [ 'as' ( Id | '_' ) ] ';' | 'use' UseTree ';' | Fn | 'type' Id [ Generics ] [ ':' Bounds ] [ Where ] [ '=' Type ] [ Where ] ';'
  | 'struct' Id [ Generics ] ( [ Where ] ( Fields | ';' ) | TupleFields [ Where ] ';' ) | 'union' Id [ Generics ] [ Where ] Fields | 'enum' Id [ Generics ] [ Where ] '{' [ Variant { ',' Variant } [ ',' ] ] '}'
  | 'const' ( Id | '_' ) ':' Type [ '=' Expr ] ';' | 'static' [ 'mut' ] Id ':' Type [ '=' Expr ] ';'
  | [ 'unsafe' ] [ 'auto' ] 'trait' Id [ Generics ] [ ':' [ Bounds ] ] [ Where ] '{' { InnerAttr } { Item } '}' | [ 'default' ] [ 'unsafe' ] 'impl' [ Generics ] [ 'const' ] [ '!' ] Type [ 'for' Type ] [ Where ] '{' { InnerAttr } { Item } '}'
  | [ 'unsafe' ] 'extern' [ STRING ] '{' { InnerAttr } { Item } '}' ;
MacroItem = 'macro_rules' '!' Id ( '{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';' ) | Path '!' ( '{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';' ) ;
Variant = { Attr } [ Vis ] Id [ Fields | TupleFields ] [ '=' Expr ] ;
Fields = '{' [ FieldDef { ',' FieldDef } [ ',' ] ] '}' ;
FieldDef = { Attr } [ Vis ] Id ':' Type ;
TupleFields = '(' [ TupleField { ',' TupleField } [ ',' ] ] ')' ;
TupleField = { Attr } [ Vis ] Type ;
UseTree = [ [ UsePath ] '::' ] ( '*' | '{' [ UseTree { ',' UseTree } [ ',' ] ] '}' ) | [ '::' ] UsePath [ 'as' ( Id | '_' ) ] ;
UsePath = UseSeg { '::' UseSeg } ;
UseSeg = Id | 'crate' | 'self' | 'super' ;
Fn = { 'const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' [ STRING ] } 'fn' Id [ Generics ] '(' [ FnParam { ',' FnParam } [ ',' ] ] ')' [ '->' Type ] [ Where ] ( Block | ';' ) ;
FnParam = { Attr } ( [ '&' [ LIFETIME ] ] [ 'mut' ] 'self' [ ':' Type ] | Pattern ':' Type | '...' | Pattern ':' '...' ) ;
Generics = '<' [ GenericParam { ',' GenericParam } [ ',' ] ] '>' ;
GenericParam = { Attr } ( LIFETIME [ ':' [ Lifetimes ] ] | Id [ ':' [ Bounds ] ] [ '=' Type ] | 'const' Id ':' Type [ '=' ConstArg ] ) ;
Lifetimes = LIFETIME { '+' LIFETIME } ;
Where = 'where' [ WhereItem { ',' WhereItem } [ ',' ] ] ;
WhereItem = LIFETIME ':' [ Lifetimes ] | [ ForAll ] Type ':' [ Bounds ] ;
ForAll = 'for' Generics ;
Bounds = Bound { '+' Bound } [ '+' ] ;
Bound = LIFETIME | [ '?' | '~' 'const' | 'async' ] [ ForAll ] TypePath | '(' [ '?' ] [ ForAll ] TypePath ')' | 'use' Generics ;
Type = '(' [ Type { ',' Type } [ ',' ] ] ')' | '!' | '*' ( 'const' | 'mut' ) Type | And [ LIFETIME ] [ 'mut' ] Type | '[' Type [ ';' Expr ] ']' | '_' | 'impl' Bounds | 'dyn' Bounds
  | [ ForAll ] { 'unsafe' | 'extern' [ STRING ] } 'fn' '(' [ FnTypeArg { ',' FnTypeArg } [ ',' ] ] ')' [ '->' Type ] | ForAll TypePath | TypePath [ '!' Tree ] [ '+' Bounds ] | QPath ;
And = '&' | '&&' ;
FnTypeArg = { Attr } [ ( Id | '_' ) ':' ] Type | '...' ;
TypePath = [ '::' ] TypeSeg { '::' TypeSeg } ;
TypeSeg = PathId [ [ '::' ] GenericArgs | [ '::' ] '(' [ Type { ',' Type } [ ',' ] ] ')' [ '->' Type ] ] ;
PathId = Id | 'crate' | 'self' | 'super' | 'Self' ;
QPath = '<' Type [ 'as' TypePath ] '>' '::' TypeSeg { '::' TypeSeg } ;
GenericArgs = '<' [ GenericArg { ',' GenericArg } [ ',' ] ] '>' ;
GenericArg = LIFETIME | Type | Id [ GenericArgs ] ( '=' Type | ':' Bounds ) | ConstArg ;
ConstArg = [ '-' ] Literal | Block | Id ;
Path = [ '::' ] PathSeg { '::' PathSeg } ;
PathSeg = PathId ;
Block = '{' { InnerAttr } { ';' | Stmt } [ Expr ] '}' ;
Stmt = { Attr } ( [ Vis ] Bare | 'let' Pattern [ ':' Type ] [ '=' Expr [ 'else' Block ] ] ';' | Expr ';' | BlockLike | MacroItem ) ;
BlockLike = [ LIFETIME ':' ] ( [ 'unsafe' | 'const' | 'async' [ 'move' ] ] Block | If | 'match' Expr MatchBody | 'while' Expr Block | 'loop' Block | 'for' Pattern 'in' Expr Block ) ;
If = 'if' Expr Block [ 'else' ( Block | If ) ] ;
MatchBody = '{' { InnerAttr } [ Arm ] '}' ;
Arm = { Attr } Pattern [ 'if' Expr ] '=>' ( Expr [ ',' [ Arm ] ] | BlockLike [ ',' ] [ Arm ] ) ;
Pattern = [ '|' ] PatternAlt { '|' PatternAlt } ;
PatternAlt = PatternOne [ ( '..' | '..=' | '...' ) [ PatternEnd ] ] | ( '..' | '..=' ) [ PatternEnd ] ;
PatternEnd = [ '-' ] Literal | ValuePath ;
PatternOne = [ '-' ] Literal | '_' | [ 'ref' ] [ 'mut' ] Id [ '@' PatternAlt ] | And [ 'mut' ] PatternOne | '(' [ Pattern { ',' Pattern } [ ',' ] ] ')' | '[' [ Pattern { ',' Pattern } [ ',' ] ] ']'
  | ValuePath [ '(' [ Pattern { ',' Pattern } [ ',' ] ] ')' | '{' [ FieldPat { ',' FieldPat } [ ',' ] ] '}' | '!' Tree ] | 'box' PatternOne | 'const' Block ;
FieldPat = { Attr } ( '..' | [ 'box' ] [ 'ref' ] [ 'mut' ] Id | ( Id | NUMBER ) ':' Pattern ) ;
Literal = NUMBER | STRING | CHAR | 'true' | 'false' ;
ValuePath = [ '::' ] ValueSeg { '::' ValueSeg } | '<' Type [ 'as' TypePath ] '>' '::' ValueSeg { '::' ValueSeg } ;
ValueSeg = PathId | GenericArgs ;
Expr = Binary [ ( '=' | AUG | '>' '>=' | '>=' ) Expr ] | Jump | Closure ;
Jump = 'return' [ Expr ] | 'break' [ LIFETIME ] [ Expr ] | 'continue' [ LIFETIME ] | 'yield' [ Expr ] ;
Closure = [ ForAll ] { 'static' | 'async' | 'move' | 'const' } ( '||' | '|' [ ClosureParam { ',' ClosureParam } [ ',' ] ] '|' ) ( Expr | '->' Type Block ) ;
ClosureParam = { Attr } PatternAlt [ ':' Type ] ;
Binary = ( RangeOp [ Unary ] | Unary ) { Operator ( Unary | Closure | Jump ) | RangeOp [ Unary ] | 'as' Type } ;
RangeOp = '..' | '..=' ;
Operator = BIN | '*' | '-' | '+' | '&' | '&&' | '|' | '||' | '<' | '>' | '>=' | '>' '>' ;
Unary = { '-' | '!' | '*' | And [ 'raw' ( 'const' | 'mut' ) | 'mut' ] } ( Primary | Jump | Closure | 'let' Pattern '=' Unary ) ;
Primary = Operand { '.' ( Id [ '::' GenericArgs ] | NUMBER | 'await' ) | '(' [ Expr { ',' Expr } [ ',' ] ] ')' | '[' Expr ']' | '?' } ;
Operand = Literal | ValuePath [ '{' [ StructItem { ',' StructItem } [ ',' ] ] '}' | '!' Tree ] | '(' { InnerAttr } [ Expr { ',' Expr } [ ',' ] ] ')' | '[' [ Expr ( ';' Expr | { ',' Expr } [ ',' ] ) ] ']' | BlockLike | '_' ;
StructItem = { Attr } ( Id [ ':' Expr ] | NUMBER ':' Expr | '..' [ Expr ] ) ;
"""
